"""Checks and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def null_audit(rows: DataFrame) -> DataFrame:
    """One row: the number of nulls of every column, in one pass."""
    return rows.agg(
        *(
            F.coalesce(F.sum(F.col(name).isNull().cast("bigint")), F.lit(0)).alias(name)
            for name in rows.columns
        )
    )


def rows_with_id(rows: DataFrame, value: int, key: str = "TWEET_ID") -> int:
    return rows.where(F.col(key) == F.lit(value)).count()


def rows_per_id(rows: DataFrame, key: str = "TWEET_ID") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("ROWS"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Distinct pairs of original and normalised text."""
    return rows.select("FULL_TEXT", "PROCESSED_TEXT").dropDuplicates()


def counted(rows: DataFrame, name: str | Observation, *more: Column) -> DataFrame:
    """Count rows as they pass; needs no extra job.

    A stream reports the count under ``name`` in its progress, a batch in the ``Observation``.
    """
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *more)
