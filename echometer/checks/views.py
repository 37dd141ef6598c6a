"""Accounts, posts and stored interactions derived from the test tables.

``region`` plays the accounts and ``events`` the posts; every event becomes one post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMOJI = {"🥑": "aguacate", "🙄": "cara con los ojos en blanco", "👩‍🚀": "astronauta", "👩": "mujer"}

# Emoji, short code and local name, where there is one: flags that overlap, sequences and their
# parts, keycaps, variation selectors, and a run of animals.
#: Entries of a large emoji table, made by a rule: single symbols, symbols with a skin tone, pairs joined by
#: U+200D. No entry begins with a tone or a joiner, so two entries side by side never form a third.
LARGE_EMOJI = 3500
EMOJI_BASES = ((0x1F400, 512), (0x1F680, 128), (0x1F900, 256), (0x1FA70, 128))


def emoji_base(j: int) -> str:
    for first, count in EMOJI_BASES:
        if j < count:
            return chr(first + j)
        j -= count
    raise IndexError(j)


def large_emoji(i: int) -> str:
    """Entry ``i`` of the large table; its name is ``e<i>``."""
    if i < 1024:
        return emoji_base(i)
    if i < 3024:
        return emoji_base((i - 1024) // 5) + chr(0x1F3FB + (i - 1024) % 5)
    return emoji_base(i - 3024) + "\u200d" + emoji_base(((i - 3024) * 7 + 3) % 1024)


EMOJI_TABLE = [
    ("🇺🇸", ":us:", "estados unidos"),
    ("🇸🇸", ":south_sudan:", "sudán del sur"),
    ("🇸🇻", ":el_salvador:", "el salvador"),
    ("🇪🇸", ":es:", None),
    ("👩‍🚀", ":woman_astronaut:", "astronauta"),
    ("👩", ":woman:", "mujer"),
    ("🚀", ":rocket:", "cohete"),
    ("1️⃣", ":one:", "uno"),
    ("❤️", ":red_heart:", "corazón"),
    ("❤️‍🔥", ":heart_on_fire:", None),
    *((chr(0x1F400 + k), f":animal_{k}:", f"animal número {k}" if k % 3 else None) for k in range(30)),
]

WEIGHTS = {
    "hola": 1.0,
    "gracias": 1.5,
    "ok": 0.5,
    "aguacate": 0.75,
    "nota": -0.25,
    "fin": -0.5,
    "cc": -1.5,
    "hoy": 0.25,
    "tal": -0.75,
    "the": 0.25,
    "and": -0.25,
    "que": 0.5,
    "le": -0.25,
    "der": -0.5,
    "sch": 0.25,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "word string, weight double")


def _handle(name: str) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    handle = _handle("r_name")
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("id"),
        handle.alias("account"),
        F.initcap("r_name").alias("name"),
        F.concat(F.lower(handle), F.lit(".jpg")).alias("image"),
        F.concat(F.lit("#00000"), F.col("r_regionkey").cast("string")).alias("color"),
        F.lit(None).cast("string").alias("party"),
        F.col("r_regionkey").cast("bigint").alias("position"),
    )


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored interactions: one row per event, its target chosen by the user id."""
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    targets = table(spark, sf_dir, "region").select(
        "r_regionkey", F.col("r_name").alias("TARGET"), _handle("r_name").alias("ACCOUNT")
    )
    account = F.col("ACCOUNT")
    text = (
        F.when(kind == "view", _said("@", account, " hola #tag", user, "!  ok"))
        .when(kind == "click", _said("RT @", account, " gracias https://t.co/", event, "?a=1 fin"))
        .when(kind == "error", _said("@other cc @", account))
        .when(kind == "signup", _said("hoy @", account, " @x1 @x2 ¿qué tal?"))
        .otherwise(_said("Nota de @", account, " n", user % 7))
    )
    return (
        table(spark, sf_dir, "events")
        .join(targets, user % 5 == F.col("r_regionkey"))
        .select(
            event.alias("TWEET_ID"),
            "TARGET",
            "ACCOUNT",
            F.col("ts").alias("TWEET_TIMESTAMP"),
            text.alias("FULL_TEXT"),
            F.when(user % 3 == 0, account).when(user % 3 == 1, "").alias("REPLY_TO"),
            F.when(kind == "click", 1).otherwise(0).alias("IS_RT"),
            F.when(user % 11 != 0, F.col("value") / (F.col("value") + 15.0)).alias("SENTIMENT"),
        )
    )


def newest_second(spark: SparkSession, sf_dir: str) -> str:
    """The latest event time, as text: what the time-relative queries take for now."""
    newest = table(spark, sf_dir, "events").agg(F.max("ts").cast("string").alias("ts"))
    return newest.first()["ts"]


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested posts: mentions of one or two accounts in either case, replies, retweets, emoji."""
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    region = table(spark, sf_dir, "region")
    first = region.select(F.col("r_regionkey").alias("k1"), _handle("r_name").alias("a"))
    second = region.select(F.col("r_regionkey").alias("k2"), _handle("r_name").alias("b"))
    a, b = F.col("a"), F.col("b")
    more = F.when(event % 4 == 0, _said(" y @", b)).otherwise("")
    body = (
        F.when(kind == "view", _said("@", a, " hola #tag", user, "!  ok 🥑", more))
        .when(kind == "click", _said("gracias https://t.co/", event, "?a=1 fin", more))
        .when(kind == "error", _said("@other cc @", a, more))
        .when(kind == "signup", _said("hoy @", a, " @x1 @x2 ¿qué tal? 🙄", more))
        .otherwise(_said("Nota de @", F.lower(a), " n", user % 7, " me@", a, ".com", more))
    )
    repeated = F.when(
        kind == "click",
        F.struct(
            body.alias("full_text"),
            F.struct(F.when(event % 2 == 0, a).otherwise("zzz").alias("screen_name")).alias("user"),
        ),
    )
    return (
        table(spark, sf_dir, "events")
        .join(first, user % 5 == F.col("k1"))
        .join(second, (user + 1 + event % 3) % 5 == F.col("k2"))
        .select(
            event.alias("id"),
            F.date_format("ts", "EEE MMM dd HH:mm:ss +0000 yyyy").alias("created_at"),
            F.when(kind == "click", _said("RT @…")).otherwise(body).alias("full_text"),
            F.when(event % 10 == 3, "en").otherwise("es").alias("lang"),
            F.when(event % 5 == 0, a)
            .when(event % 5 == 1, F.lower(b))
            .when(event % 5 == 2, "")
            .alias("in_reply_to_screen_name"),
            F.struct(
                _said("user", user).alias("screen_name"),
                (user * 7).alias("followers_count"),
                (user * 3).alias("favourites_count"),
                (user % 100).alias("friends_count"),
                event.alias("statuses_count"),
                _said(F.date_add(F.lit("2015-01-01").cast("date"), (user % 1000).cast("int")), " 06:07:08").alias(
                    "created_at"
                ),
            ).alias("user"),
            repeated.alias("retweeted_status"),
        )
    )
