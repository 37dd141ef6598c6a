"""Which tracked accounts a post is directed at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echometer.functions.text import mentions
from echometer.operators.joins import join_dimension, join_value
from echometer.session import settled

INLINE_ACCOUNTS = 20_000


def in_language(posts: DataFrame, language: str | None, column: str = "LANG") -> DataFrame:
    return posts if language is None else posts.where(F.col(column) == F.lit(language))


def _account_columns(accounts: DataFrame) -> DataFrame:
    return accounts.where(F.length("account") > 0).select(
        F.lower("account").alias("_handle"),
        F.col("id").alias("TARGET"),
        F.col("account").alias("ACCOUNT"),
    )


def _replied_to(reply: str) -> Column:
    return F.lower(F.nullif(F.col(reply), F.lit("")))


def _nobody() -> Column:
    return F.array().cast("array<string>")


def directed_at(
    posts: DataFrame, accounts: DataFrame, text: str = "FULL_TEXT", reply: str = "REPLY_TO"
) -> DataFrame:
    """A row per post and account it replies to or mentions, whoever else it mentions.

    Adds ``TARGET``, ``ACCOUNT`` and ``IS_REPLY``.
    """
    replied = F.when(_replied_to(reply).isNull(), _nobody()).otherwise(F.array(_replied_to(reply)))
    fanned = posts.withColumn("_handle", F.explode(F.array_union(mentions(F.col(text)), replied)))
    joined = join_dimension(fanned, _account_columns(accounts), "_handle")
    return joined.withColumn("IS_REPLY", F.col("_handle").eqNullSafe(_replied_to(reply))).drop("_handle")


def assign_targets(
    posts: DataFrame,
    accounts: DataFrame,
    text: str = "FULL_TEXT",
    reply: str = "REPLY_TO",
    key: str = "TWEET_ID",
    inline_accounts: int = INLINE_ACCOUNTS,
) -> DataFrame:
    """A row per post and account it is directed at.

    A reply to an account always counts. A mention counts only if no other tracked account is
    mentioned in the same post. Handles match whole and without regard to case.

    The accounts are a constant of the plan, so that one narrow pass decides; a list of more than
    ``inline_accounts`` is joined instead, which needs a batch frame. Both give the same rows.
    """
    return _judged(posts, accounts, text, reply, key, inline_accounts).where("_counts").drop("_counts")


def co_mentioned(
    posts: DataFrame,
    accounts: DataFrame,
    text: str = "FULL_TEXT",
    reply: str = "REPLY_TO",
    key: str = "TWEET_ID",
    inline_accounts: int = INLINE_ACCOUNTS,
) -> DataFrame:
    """Pairs of post key and target that only the co-mention rule rejects."""
    judged = _judged(posts, accounts, text, reply, key, inline_accounts)
    return judged.where(~F.col("_counts")).select(key, "TARGET")


def _judged(
    posts: DataFrame, accounts: DataFrame, text: str, reply: str, key: str, inline_accounts: int
) -> DataFrame:
    """Posts per account they are directed at in any way; ``_counts`` is the rule's verdict."""
    known = _account_columns(accounts)
    rows = known.limit(inline_accounts + 1).collect()
    if len(rows) > inline_accounts:
        return _judged_by_join(posts, known, text, reply)
    inline = F.broadcast(accounts.sparkSession.createDataFrame(rows, known.schema))
    # A constant list is looked up by hash, whatever its length.
    tracked = sorted({row["_handle"] for row in rows})
    replied = F.lower(F.col(reply))
    fanned = (
        posts.withColumns(
            {
                "_named": F.filter(mentions(F.col(text)), lambda handle: handle.isin(tracked)),
                "_replied": F.when(replied.isin(tracked), F.array(replied)).otherwise(_nobody()),
            }
        )
        .withColumn("_handle", F.explode(F.array_union("_named", "_replied")))
        .withColumn("_counts", (F.size("_named") <= 1) | F.array_contains("_replied", F.col("_handle")))
        .drop("_named", "_replied")
    )
    return fanned.join(inline, "_handle").drop("_handle")


def _judged_by_join(posts: DataFrame, accounts: DataFrame, text: str, reply: str) -> DataFrame:
    """As ``_judged`` for an account list of any size.

    The rule depends on the set of mentioned handles alone, so sets are judged, not posts: pairs of
    set digest and tracked handle are counted per task before they are shuffled, and sets that many
    posts share find their verdict by broadcast.
    """
    digest = F.sha2(F.array_join(F.array_sort(mentions(F.col(text))), " "), 256)
    posts = posts.withColumn("_set", digest)
    named = posts.select("_set", F.explode(mentions(F.col(text))).alias("_handle"))
    crowded = (
        join_dimension(named, accounts.select("_handle").distinct(), "_handle", "left_semi")
        .groupBy("_set", "_handle")
        .agg(F.count(F.lit(1)).alias("_times"))
        .groupBy("_set")
        .agg(F.count(F.lit(1)).alias("_named"), F.sum("_times").alias("_copies"))
        .where(F.col("_named") > 1)
    )
    pairs = directed_at(posts, accounts.withColumnsRenamed({"TARGET": "id", "ACCOUNT": "account"}), text, reply)
    return (
        join_value(pairs, settled(crowded), "_set", "_copies")
        .withColumn("_counts", F.col("_named").isNull() | F.col("IS_REPLY"))
        .drop("_named", "IS_REPLY", "_set")
    )


def high_water_marks(facts: DataFrame, target: str = "TARGET", key: str = "TWEET_ID") -> DataFrame:
    """Largest stored post id of every target."""
    return facts.groupBy(target).agg(F.max(key).alias("MAX_ID"))


def after_high_water(
    rows: DataFrame, marks: DataFrame, target: str = "TARGET", key: str = "TWEET_ID"
) -> DataFrame:
    """Rows beyond their target's mark; a target without one keeps all its rows.

    The marks, one row per target, are computed once and broadcast if they are few.
    """
    known = settled(marks.select(target, F.col("MAX_ID").alias("_mark")))
    return (
        join_dimension(rows, known, target, "left")
        .where(F.col("_mark").isNull() | (F.col(key) > F.col("_mark")))
        .drop("_mark")
    )


def latest_k(
    rows: DataFrame, k: int, target: str = "TARGET", key: str = "TWEET_ID", salts: int = 256
) -> DataFrame:
    """The ``k`` rows with the largest ids per target.

    Two rounds: a target's rows first compete within groups of input partitions, each of which
    passes on at most ``k`` of them, so that the second round sorts at most ``salts * k`` rows of
    a target, however large its share.
    """
    newest = F.desc(key)
    first = Window.partitionBy(target, "_salt").orderBy(newest)
    last = Window.partitionBy(target).orderBy(newest)
    return (
        rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(last))
        .where(F.col("_rank") <= k)
        .drop("_salt", "_rank")
    )
