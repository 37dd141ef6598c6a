"""Schemas shared by readers, the ingest plan and the fact table."""

from pyspark.sql import types as T

ACCOUNTS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("id", "account", "name", "image", "color", "party")]
)

EMOJI_NAMES = T.StructType([T.StructField("emoji", T.StringType()), T.StructField("name", T.StringType())])


_AUTHOR = T.StructType(
    [
        T.StructField("screen_name", T.StringType()),
        T.StructField("followers_count", T.LongType()),
        T.StructField("favourites_count", T.LongType()),
        T.StructField("friends_count", T.LongType()),
        T.StructField("statuses_count", T.LongType()),
        T.StructField("created_at", T.StringType()),
    ]
)

_RETWEETED = T.StructType(
    [
        T.StructField("full_text", T.StringType()),
        T.StructField("user", T.StructType([T.StructField("screen_name", T.StringType())])),
    ]
)

STATUS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("in_reply_to_screen_name", T.StringType()),
        T.StructField("user", _AUTHOR),
        T.StructField("retweeted_status", _RETWEETED),
    ]
)

# Column names and order of the interaction frame and the fact table.
INTERACTION = T.StructType(
    [
        T.StructField("TWEET_ID", T.LongType(), False),
        T.StructField("TARGET", T.StringType(), False),
        T.StructField("INSERT_TIMESTAMP", T.TimestampType(), False),
        T.StructField("FULL_TEXT", T.StringType()),
        T.StructField("PROCESSED_TEXT", T.StringType()),
        T.StructField("FOLLOWERS_COUNT", T.LongType()),
        T.StructField("FAVOURITES_COUNT", T.LongType()),
        T.StructField("FRIENDS_COUNT", T.LongType()),
        T.StructField("TWEETS_COUNT", T.LongType()),
        T.StructField("ACCOUNT_CREATION_DATE", T.TimestampType()),
        T.StructField("TWEET_TIMESTAMP", T.TimestampType(), False),
        T.StructField("IS_RT", T.IntegerType(), False),
    ]
)

FACT = T.StructType(INTERACTION.fields + [T.StructField("SENTIMENT", T.DoubleType())])

PARTITION_DAY = "event_date"
PARTITION_BATCH = "ingest_batch"
