"""Emoji names from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echometer.functions.emoji import TABLE_LIMIT
from echometer.schemas import EMOJI_NAMES


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``emoji, name`` rows of one CSV file; the last of repeated keys wins."""
    rows = (
        spark.read.schema(EMOJI_NAMES)
        .option("header", True)
        .csv(path)
        .where(F.length("emoji") > 0)
        .withColumn("line", F.monotonically_increasing_id())
    )
    return rows.groupBy("emoji").agg(F.max_by("name", "line").alias("name"))


def translate_names(codes: DataFrame, local: DataFrame) -> DataFrame:
    """Fold emoji -> short code and short code -> local name into emoji -> local name.

    Both are ``emoji, name`` frames, the keys of ``local`` being short codes. A code without a
    local name stays as it is.
    """
    spoken = local.select(F.col("emoji").alias("name"), F.col("name").alias("spoken"))
    return codes.join(spoken, "name", "left").select(
        "emoji", F.coalesce("spoken", "name").alias("name")
    )


def as_mapping(names: DataFrame) -> dict[str, str]:
    """The table as a dictionary; refuses more entries than Unicode could need."""
    rows = names.limit(TABLE_LIMIT + 1).collect()
    if len(rows) > TABLE_LIMIT:
        raise ValueError(f"more than {TABLE_LIMIT} emoji names")
    return {row["emoji"]: row["name"] or "" for row in rows}
