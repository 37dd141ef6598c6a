"""Joins that hold when a few keys have most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echometer.session import holds_at_most

BROADCAST_ROWS = 100_000
HOT_KEYS = 1_000
SALTS = 1_024


def join_dimension(
    rows: DataFrame,
    dimension: DataFrame,
    key: str,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    lanes: int = 32,
) -> DataFrame:
    """Join rows to a dimension, broadcast if it holds at most ``broadcast_rows`` rows.

    A larger one is repeated in ``lanes`` copies, and the rows of one key are dealt out to them
    by input partition, so that no task gets more than its share of a hot key.
    """
    if holds_at_most(dimension, broadcast_rows):
        return rows.join(F.broadcast(dimension), key, how)
    dealt = rows.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    repeated = dimension.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return dealt.join(repeated, [key, "_lane"], how).drop("_lane")


def text_digest(*texts: str) -> Column:
    """SHA-256 of one or more text columns; null is a value of its own.

    Joins on the digest move 64 characters instead of whole texts and match null to null.
    """
    parts = [
        F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), F.col(text)), F.lit("null;"))
        for text in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def join_value(
    rows: DataFrame,
    values: DataFrame,
    key: str,
    copies: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join ``rows`` to ``values``, one per ``key``, whose ``copies`` counts its rows.

    ``values`` must be cheap to read again (a checkpoint or table). If they are few they are
    broadcast. Otherwise the values of keys with more than one in ``hot_keys`` of all rows, hence
    fewer than ``hot_keys`` values, are broadcast, and only the other rows have to meet their
    value in a shuffle; rows already served are spread over it evenly. ``key`` must not be null.
    """
    named = [name for name in values.columns if name not in (key, copies)]
    if holds_at_most(values, broadcast_rows):
        return rows.join(F.broadcast(values.drop(copies)), key, "left")

    total = values.agg(F.sum(copies).alias("n")).first()["n"]
    is_hot = F.col(copies) * hot_keys > F.lit(total)
    hot = values.where(is_hot).select(key, F.struct(*named).alias("_hot"))
    cold = values.where(~is_hot).select(F.col(key).alias("_key"), F.struct(*named).alias("_cold"))
    # Rows already served look for a key that no value has. The input partition picks it, so that
    # a repeated task sends its rows the same way again.
    lane = F.concat(F.lit("lane "), F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("string"))
    served = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(lane)
    )
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return served.join(cold, "_key", "left").select(
        *rows.columns, *(found[name].alias(name) for name in named)
    )
