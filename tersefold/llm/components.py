"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b): label is the smallest node it can reach.

    Every round a node takes the smallest label among its neighbours and then
    the label of that label, so paths shorten by jumps and rounds grow with the
    logarithm of their length. Minima are combined before they are shuffled,
    so a hub's edges do not meet in one task. Rounds are written tables.
    """
    both = stage(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "edges")
    labels = stage(both.groupBy("src").agg(F.min("dst").alias("near")).select(
        F.col("src").alias("node"), F.least("src", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(
            F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("src", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stage(hooked.join(root, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        moved = not jumped.filter("label != old").isEmpty()
        labels = jumped.select("node", "label")
        if not moved:
            return labels
