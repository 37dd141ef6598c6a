"""Connected components of a table of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echometer.llm import common


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that links lead to, for all nodes of (``a``, ``b``).

    Each round takes the smallest label among a node and its neighbours, then the label of that label.
    Labels are summed up per task before the shuffle, so a node with very many links has no large group;
    each round is a table in the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = common.stored(both.filter("a <> b").distinct(), "links")
    labels = common.stored(
        edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"),
        "labels",
    )
    while True:
        # The smallest label around each node.
        around = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("around"))
        )
        lower = labels.join(around, "node").select(
            "node", "component", F.least("component", "around").alias("lower")
        )
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("further"))
        following = common.stored(
            lower.join(jump, "lower").select(
                "node", F.least("lower", "further").alias("component"), (F.least("lower", "further") < F.col("component")).alias("moved")
            ),
            "labels",
        )
        labels = following.select("node", "component")
        if not following.filter("moved").limit(1).count():
            return labels
