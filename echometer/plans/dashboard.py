"""Rolling metrics and the latest interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echometer.functions.clock import AsOf, like_column, minutes_before
from echometer.functions.display import (
    compact_number,
    display_time,
    label_color,
    percent_text,
    positive_share,
    score_band,
    score_color,
    sentiment_label,
)
from echometer.schemas import PARTITION_DAY

# The windows on offer in minutes, and the number of latest interactions.
WINDOWS = (15, 60, 1440)
LATEST = 5


def checked_minutes(minutes: int) -> int:
    """Any window that is not on offer means the shortest one."""
    return minutes if minutes in WINDOWS else WINDOWS[0]


def recent(
    facts: DataFrame, minutes: int = 15, exclude_retweets: bool = False, as_of: AsOf = None
) -> DataFrame:
    """Rows of the last ``minutes``, posts dated later than ``as_of`` included.

    The bound is a whole second, so comparing the bare column equals comparing its whole seconds.
    It is repeated on the day partitions, of which only the last one or two are then listed.
    """
    since = minutes_before(as_of, checked_minutes(minutes))
    kept = F.col("TWEET_TIMESTAMP") >= like_column(since, facts.schema["TWEET_TIMESTAMP"].dataType)
    if PARTITION_DAY in facts.columns:
        kept = kept & (F.col(PARTITION_DAY) >= F.to_date(since))
    if exclude_retweets is True:
        kept = kept & (F.col("IS_RT") == 0)
    return facts.where(kept)


def account_metrics(
    facts: DataFrame, minutes: int = 15, exclude_retweets: bool = False, as_of: AsOf = None
) -> DataFrame:
    """Interactions and approval (0 to 100) per target; partial sums leave each task."""
    return (
        recent(facts, minutes, exclude_retweets, as_of)
        .groupBy(F.col("TARGET").alias("target"))
        .agg(
            F.count(F.lit(1)).alias("responses"),
            positive_share(F.col("SENTIMENT")).alias("sentiment"),
        )
    )


def account_cards(accounts: DataFrame, metrics: DataFrame) -> DataFrame:
    """What each account's card shows, in account order.

    Accounts without interactions and targets without an account have no card. The metrics are
    already one row per target when they meet the accounts.
    """
    return (
        accounts.join(metrics, accounts["id"] == metrics["target"])
        .select(
            "position",
            "target",
            "name",
            "image",
            "color",
            "party",
            "responses",
            compact_number(F.col("responses")).alias("responses_text"),
            "sentiment",
            percent_text(F.col("sentiment")).alias("approval_text"),
            score_band(F.col("sentiment")).alias("approval_band"),
            score_color(F.col("sentiment")).alias("approval_color"),
        )
        .orderBy("position")
    )


def totals(metrics: DataFrame) -> DataFrame:
    """All interactions, and the mean of the targets' approvals: every target weighs the same."""
    return metrics.agg(
        F.coalesce(F.sum("responses"), F.lit(0)).alias("responses"),
        F.coalesce(F.avg(F.nanvl("sentiment", F.lit(None).cast("double"))), F.lit(0.0)).alias("sentiment"),
    )


def headline(metrics: DataFrame) -> DataFrame:
    """The totals as shown."""
    return totals(metrics).select(
        "responses",
        compact_number(F.col("responses")).alias("responses_text"),
        "sentiment",
        percent_text(F.col("sentiment")).alias("approval_text"),
        score_color(F.col("sentiment")).alias("approval_color"),
    )


def latest_posts(
    facts: DataFrame,
    minutes: int = 15,
    exclude_retweets: bool = False,
    as_of: AsOf = None,
    most: int = LATEST,
) -> DataFrame:
    """The newest interactions of the window; the larger id comes first at equal seconds."""
    return (
        recent(facts, minutes, exclude_retweets, as_of)
        .select(
            "TWEET_ID",
            F.col("TARGET").alias("target"),
            F.col("TWEET_TIMESTAMP").alias("tweet_timestamp"),
            F.col("FULL_TEXT").alias("full_text"),
            F.col("SENTIMENT").alias("score"),
        )
        .orderBy(F.date_trunc("second", "tweet_timestamp").desc(), F.desc("TWEET_ID"))
        .limit(most)
    )


def latest_cards(latest: DataFrame, accounts: DataFrame) -> DataFrame:
    """What the list of latest interactions shows; a target without an account is an error."""
    images = accounts.select("id", "image", F.lit(True).alias("known"))
    image = F.when(F.col("known"), F.col("image")).otherwise(
        F.raise_error(F.concat(F.lit("no account with id "), "target"))
    )
    return (
        latest.join(images, latest["target"] == images["id"], "left")
        .withColumn("image", image)
        .orderBy(F.date_trunc("second", "tweet_timestamp").desc(), F.desc("TWEET_ID"))
        .select(
            "target",
            display_time(F.col("tweet_timestamp")).alias("time"),
            "image",
            "full_text",
            sentiment_label(F.col("score")).alias("sentiment"),
            label_color(F.col("score")).alias("color"),
        )
    )
