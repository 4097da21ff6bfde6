"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.storage import shuffled, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; a component is named by its least node.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so a chain of n nodes needs about log2(n) rounds. Every
    round is one aggregation and three shuffled equi-joins; labels are cut to shared
    storage, so nothing is gathered or broadcast and lineage stays short. Rounds end when no label
    changes; labels only fall, so they always do.
    Null endpoints and self-loops are allowed: nulls are dropped, a loop keeps its node.
    """
    e = edges.select(F.col(a).alias("s"), F.col(b).alias("d")).dropna()
    e = stage(e.union(e.select("d", "s")).distinct())
    labels = stage(e.groupBy(F.col("s").alias("node")).agg(F.least(F.min("d"), F.first("s")).alias("component")))
    while True:
        near = e.join(shuffled(labels), e.d == labels.node).groupBy("s").agg(F.min("component").alias("near"))
        hooked = labels.join(shuffled(near), labels.node == near.s).select("node", F.col("component").alias("old"), F.least("component", "near").alias("hook"))
        root = labels.select(F.col("node").alias("hook"), F.col("component").alias("root"))
        now = stage(hooked.join(shuffled(root), "hook").select("node", "old", F.least("hook", "root").alias("component")))
        labels = now.select("node", "component")
        if now.filter(F.col("old") != F.col("component")).isEmpty():
            return labels
