"""Nested posts to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echometer.functions.clock import post_time


def is_retweet() -> Column:
    """Whether the post carries another one, with its author and text."""
    return F.col("retweeted_status.user.screen_name").isNotNull() & F.col(
        "retweeted_status.full_text"
    ).isNotNull()


def complete_text() -> Column:
    """A retweet's text is rebuilt from the post it repeats, since its own is cut off."""
    return F.when(
        is_retweet(),
        F.concat(
            F.lit("RT @"),
            F.col("retweeted_status.user.screen_name"),
            F.lit(" "),
            F.col("retweeted_status.full_text"),
        ),
    ).otherwise(F.col("full_text"))


def flatten(posts: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """One flat row per post, plus ``REPLY_TO`` and ``LANG`` for the filters that follow."""
    return posts.select(
        F.col("id").alias("TWEET_ID"),
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("INSERT_TIMESTAMP"),
        complete_text().alias("FULL_TEXT"),
        F.col("user.followers_count").alias("FOLLOWERS_COUNT"),
        F.col("user.favourites_count").alias("FAVOURITES_COUNT"),
        F.col("user.friends_count").alias("FRIENDS_COUNT"),
        F.col("user.statuses_count").alias("TWEETS_COUNT"),
        post_time(F.col("user.created_at")).alias("ACCOUNT_CREATION_DATE"),
        post_time(F.col("created_at")).alias("TWEET_TIMESTAMP"),
        is_retweet().cast("int").alias("IS_RT"),
        F.col("in_reply_to_screen_name").alias("REPLY_TO"),
        F.col("lang").alias("LANG"),
    )
