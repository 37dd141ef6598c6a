"""Continuous ingest of raw posts into the fact table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echometer.functions.clock import not_after_now
from echometer.operators.audit import counted
from echometer.operators.scoring import Scorer
from echometer.operators.targets import INLINE_ACCOUNTS
from echometer.plans.ingest import add_sentiment, directed_posts, usable_posts, with_processed_text
from echometer.session import adaptive, holds_at_most, keeps_old_checkpoints
from echometer.sources.facts import write_batch

LATENESS = "2 days"
COPY_LANES = 16


def drop_repeats(directed: DataFrame, lateness: str = LATENESS, lanes: int = COPY_LANES) -> DataFrame:
    """Keep one row per target and post id among rows within ``lateness`` of each other.

    A stateful operator has no partial step before its shuffle. So copies are first dropped
    within lanes of input partitions: a post repeated a million times meets in ``lanes`` tasks
    and only that many copies reach the final one. One lane means the final step alone, for
    sources whose repeats are rare.
    """
    dated = directed.withColumn("_moment", not_after_now(F.col("TWEET_TIMESTAMP"))).withWatermark(
        "_moment", lateness
    )
    if lanes > 1:
        dated = (
            dated.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
            .dropDuplicatesWithinWatermark(["TARGET", "TWEET_ID", "_lane"])
            .drop("_lane")
        )
    return dated.dropDuplicatesWithinWatermark(["TARGET", "TWEET_ID"]).drop("_moment")


def start_ingest(
    posts: DataFrame,
    accounts: DataFrame,
    scorer: Scorer,
    table: str,
    checkpoint: str,
    interval: str | None = None,
    language: str | None = None,
    emoji: dict[str, str] | None = None,
    lateness: str = LATENESS,
    lanes: int = COPY_LANES,
    name: str = "ingest",
) -> StreamingQuery:
    """Start the stream ``posts`` -> ``table``.

    ``interval`` is the time between starts of micro-batches (an overlong batch is followed by
    the next at once); without it the query takes what is available and ends. Each micro-batch
    is written under its own name, so that a repeated one replaces its rows.

    Posts without id or readable time are counted as unusable and left out. Repeated posts are
    recognised by state: the copy that comes first stays. Rows later than ``lateness`` are left out
    as well; the difference of the counters ``directed`` and ``kept`` holds them and the repeats,
    and the progress of the state operators tells them apart.
    The accounts are a constant of the plan, which bounds their number.
    """
    if not holds_at_most(accounts, INLINE_ACCOUNTS):
        raise ValueError(f"a stream follows at most {INLINE_ACCOUNTS} accounts")
    if scorer.costly and keeps_old_checkpoints(posts.sparkSession):
        warnings.warn("every micro-batch leaves checkpoint files behind; see session.AT_START", stacklevel=2)
    directed = counted(directed_posts(usable_posts(posts, "received"), accounts, language), "directed")
    rows = counted(drop_repeats(directed, lateness, lanes), "kept")

    def store(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        fresh = with_processed_text(batch, emoji)
        if not scorer.costly:
            # Files by volume, not by the number of state partitions.
            with adaptive(batch.sparkSession):
                write_batch(add_sentiment(fresh, scorer), table, f"{run}-{batch_id}")
            return
        # Read twice: for the distinct texts, and for the rows that take their scores.
        fresh = fresh.persist()
        try:
            if not fresh.isEmpty():
                with adaptive(batch.sparkSession):
                    write_batch(add_sentiment(fresh, scorer), table, f"{run}-{batch_id}")
        finally:
            fresh.unpersist()

    writer = (
        rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).queryName(name)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
