"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Temporary, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in edges (a, b).

    Each round a node takes the smallest label among its own and its
    neighbours', then the label of that label. Minima are taken within tasks
    before labels meet, so a node with very many links is no burden to one
    task. Each round is written out; nothing is kept in executors.
    """
    of_edges, last = Temporary(edges.sparkSession), Temporary(edges.sparkSession)
    both = of_edges.staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = last.staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("node").alias("via"), F.col("component").alias("far"))
        before, last = last, Temporary(edges.sparkSession)
        new = last.staged(lower.join(jump, F.col("component") == F.col("via"), "left").select("node", "was", F.least("component", "far").alias("component")), "labels")
        before.drop()
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            labels = staged(labels, "components")
            of_edges.drop()
            last.drop()
            return labels
