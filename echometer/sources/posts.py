"""Raw posts from a JSON landing zone, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echometer.schemas import STATUS


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS).json(path)


def stream_posts(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None
) -> DataFrame:
    """New files of the landing zone; the caps bound one micro-batch, not the stream."""
    reader = spark.readStream.schema(STATUS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.json(path)


def posts_from_text(messages: DataFrame, value: str | Column = "value") -> DataFrame:
    """Posts out of a column of JSON texts, such as the value of a message queue source."""
    column = F.col(value) if isinstance(value, str) else value
    return messages.select(F.from_json(column.cast("string"), STATUS).alias("post")).select("post.*")
