"""From raw posts to scored interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from echometer.functions.clock import post_time
from echometer.functions.text import normalize
from echometer.operators.audit import counted
from echometer.operators.flatten import flatten
from echometer.operators.relevance import keep_relevant
from echometer.operators.scoring import Scorer, score_deduplicated, score_with_rule
from echometer.operators.targets import (
    after_high_water,
    assign_targets,
    high_water_marks,
    in_language,
    latest_k,
)
from echometer.schemas import FACT, INTERACTION

_ONE_ROW = ["TARGET", "TWEET_ID"]
# A post's counters only rise by and large, so the copy with the largest ones was taken last.
_NEWEST_COPY = ["TWEETS_COUNT", "FAVOURITES_COUNT", "FOLLOWERS_COUNT", "FRIENDS_COUNT", "TWEET_TIMESTAMP", "FULL_TEXT"]


def usable_posts(posts: DataFrame, counter: str | Observation | None = None) -> DataFrame:
    """Posts with an id and a readable time; a ``counter`` gets the number of the others as ``unusable``."""
    usable = F.col("id").isNotNull() & post_time(F.col("created_at")).isNotNull()
    if counter is not None:
        posts = counted(posts, counter, F.count_if(~usable).alias("unusable"))
    return posts.where(usable)


def newest_copies(directed: DataFrame) -> DataFrame:
    """One row per target and post id: the copy with the largest counters, then the largest other columns.

    One read and one shuffle. The row is the maximum of a struct of the counters followed by every other
    column, so copies are combined before the shuffle (partial aggregation): a post repeated a million
    times leaves each task once. Nulls lose to values, and copies that differ in any column have one
    winner whatever their order.
    """
    others = [name for name in directed.columns if name not in _ONE_ROW and name not in _NEWEST_COPY]
    best = F.max(F.struct(*_NEWEST_COPY, *others)).alias("_best")
    return directed.groupBy(*_ONE_ROW).agg(best).select(
        *(F.col(f"_best.{name}").alias(name) if name not in _ONE_ROW else F.col(name) for name in directed.columns)
    )


def directed_posts(
    posts: DataFrame,
    accounts: DataFrame,
    language: str | None = None,
    ingested_at: Column | None = None,
    stored: DataFrame | None = None,
    most_recent: int | None = None,
) -> DataFrame:
    """Flat posts per account they are directed at, irrelevant ones dropped; no shuffle.

    Two options bound a batch pull before the relevance rules. ``stored`` facts leave only posts
    with larger ids than an account has there. ``most_recent`` is the page size of a search
    service, the newest posts per account, copies counted once; by default nothing is cut off.
    """
    assigned = assign_targets(in_language(flatten(posts, ingested_at), language), accounts)
    if stored is not None:
        assigned = after_high_water(assigned, high_water_marks(stored))
    if most_recent is not None:
        assigned = latest_k(newest_copies(assigned), most_recent)
    return keep_relevant(assigned)


def with_processed_text(directed: DataFrame, emoji: dict[str, str] | None = None) -> DataFrame:
    return directed.withColumn("PROCESSED_TEXT", normalize(F.col("FULL_TEXT"), emoji))


def interactions(
    posts: DataFrame,
    accounts: DataFrame,
    language: str | None = None,
    emoji: dict[str, str] | None = None,
    ingested_at: Column | None = None,
) -> DataFrame:
    """The interaction frame: twelve columns in their fixed order."""
    directed = directed_posts(posts, accounts, language, ingested_at)
    return with_processed_text(directed, emoji).select(*INTERACTION.fieldNames())


def add_sentiment(directed: DataFrame, scorer: Scorer, deduplicate: bool | None = None) -> DataFrame:
    """Score rows that still carry ``ACCOUNT``; returns the thirteen columns of a stored row.

    By default only a costly scorer is worth the shuffle that shows it each text once.
    """
    if deduplicate is None:
        deduplicate = scorer.costly
    score = score_deduplicated if deduplicate else score_with_rule
    return score(directed, scorer).select(*FACT.fieldNames())


def ingest(
    posts: DataFrame,
    accounts: DataFrame,
    scorer: Scorer,
    language: str | None = None,
    emoji: dict[str, str] | None = None,
    ingested_at: Column | None = None,
    deduplicate: bool | None = None,
    stored: DataFrame | None = None,
    most_recent: int | None = None,
) -> DataFrame:
    """The whole path as one batch.

    Unusable posts are left out as in the stream, and of a target's copies of a post the newest stays.
    """
    directed = directed_posts(usable_posts(posts), accounts, language, ingested_at, stored, most_recent)
    once = directed if most_recent is not None else newest_copies(directed)
    return add_sentiment(with_processed_text(once, emoji), scorer, deduplicate)
