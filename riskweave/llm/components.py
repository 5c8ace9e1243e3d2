"""Connected components of an edge table, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in ``edges`` (a, b); component is the smallest node.

    Each round a node takes the smallest label among its neighbours and itself, and the
    label of that label; rounds go on until no label changes. No node's neighbours are
    gathered: minima are aggregated before they are shuffled.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        near = written(labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("near")), "near")
        far = near.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = near.join(far, "near", "left").select("node", "old", F.least("near", F.coalesce("far", "near")).alias("component"))
        new = written(new, "labels")
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
