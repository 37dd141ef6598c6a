"""Ascending ids over many partitions: buckets of ids between quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echometer.llm import common


def id_bounds(rows: DataFrame, key: str = "doc_id") -> list[int]:
    """Sorted ids that part the rows into about as many buckets as there are shuffle partitions."""
    partitions = common.shuffle_partitions(rows.sparkSession)
    quantiles = [k / partitions for k in range(1, partitions)]
    if not quantiles:
        return []
    found = rows.select(F.percentile_approx(key, quantiles, 100 * partitions)).first()[0]
    return sorted(set(found or []))


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, by binary search; null is 0."""
    size = 1 << len(bounds).bit_length()
    padded = F.lit(bounds + [(1 << 63) - 1] * (size - len(bounds)))
    steps = F.lit([1 << k for k in reversed(range(size.bit_length() - 1))])
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at(padded, at + step) <= value, at + step).otherwise(at),
    )
    return F.least(place, F.lit(len(bounds)))
