"""Sliding counts over the stream of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echometer.functions.clock import not_after_now
from echometer.functions.display import positive_share
from echometer.session import adaptive


def rolling_metrics(
    interactions: DataFrame,
    length: str = "60 minutes",
    slide: str = "15 minutes",
    lateness: str = "2 days",
) -> DataFrame:
    """Interactions and approval per target and window.

    A post dated in the future counts as posted now, as it does in the queries over the last
    minutes. Rows are summed per task before they are shuffled, so a target with most of the rows costs
    no more than the others.
    """
    return (
        interactions.withColumn("_moment", not_after_now(F.col("TWEET_TIMESTAMP")))
        .withWatermark("_moment", lateness)
        .groupBy(F.window("_moment", length, slide).alias("span"), F.col("TARGET").alias("target"))
        .agg(
            F.count(F.lit(1)).alias("responses"),
            positive_share(F.col("SENTIMENT")).alias("sentiment"),
        )
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "target",
            "responses",
            "sentiment",
        )
    )


def start_rolling(
    metrics: DataFrame, path: str, checkpoint: str, interval: str | None = None, name: str = "rolling"
) -> StreamingQuery:
    """Append closed windows to Parquet files, exactly once."""
    writer = (
        metrics.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .queryName(name)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def start_current(
    metrics: DataFrame, path: str, checkpoint: str, interval: str | None = None, name: str = "current"
) -> StreamingQuery:
    """Write the windows that each micro-batch has changed, open ones too, as soon as it ends.

    A batch has a folder of its own, which a repeated batch writes again. Its rows are gathered into
    files by a shuffle of their own: each state partition stays a task, and files follow the volume.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        with adaptive(batch.sparkSession):
            changed = batch.hint("rebalance", "window_start", "target")
            changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (
        metrics.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .queryName(name)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def current_windows(spark: SparkSession, path: str) -> DataFrame:
    """The newest figures of every window and target."""
    figures = F.struct("responses", "sentiment")
    newest = spark.read.parquet(path).groupBy("window_start", "window_end", "target").agg(
        F.max_by(figures, "batch").alias("figures")
    )
    return newest.select("window_start", "window_end", "target", "figures.*")
