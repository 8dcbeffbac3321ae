"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (aggregated before the shuffle,
    so a node with a third of all edges is no single task) and then the label of that label, which
    halves the depth. Rounds end when no label changes: logarithmic in the longest chain, as a rule.
    Empty edges give an empty table; loops and repeated edges do no harm.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        hooked = cut(labels.join(near, "node").select("node", F.least("component", "least").alias("at"), F.col("component").alias("was")))
        up = hooked.select(F.col("node").alias("at"), F.col("at").alias("component"))
        labels = cut(hooked.join(up, "at").select("node", "component", "was"))
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
