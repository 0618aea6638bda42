"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for the nodes of the edges (a, b); root is the component's smallest node.

    Each round takes the least label among a node and its neighbours, then the label of that label, so that the
    distance to the root shrinks at least by half where stars meet. Rounds are written tables: lost executors cost
    one round, and the joins have fresh exchanges on either side, whose large partitions Spark can split.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        lower = scratch.table(lower, f"{name}-near")
        jump = lower.select(F.col("node").alias("_n"), F.col("next").alias("_r"))
        new = lower.join(jump, lower.next == jump._n, "left").select("node", F.least("next", "_r").alias("root"), (F.least("next", "_r") != F.col("was")).alias("moved"))
        new = scratch.table(new, f"{name}-{step}")
        moved = not new.where("moved").isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "root")
        if not moved:
            return labels
