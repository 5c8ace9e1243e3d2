"""Isolation forest: trees grow in parallel on small samples, rows are scored in place."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.models.vectors import as_matrix, score_points

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def average_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    long = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes as (node, feature, threshold, left, right, depth); a leaf has feature -1."""
    nodes: list[list] = []
    open_nodes = [(np.arange(len(x)), 0, -1, 0)]
    while open_nodes:
        rows, depth, parent, side = open_nodes.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = node
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or len(usable) == 0:
            nodes.append([node, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = x[rows, feature] <= cut
        nodes.append([node, feature, cut, -1, -1, 0.0])
        open_nodes.append((rows[~left], depth + 1, node, 1))
        open_nodes.append((rows[left], depth + 1, node, 0))
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class IsolationForest:
    nodes: pd.DataFrame     # at most trees * (2 * sample - 1) rows
    sample: int
    offset: float

    @staticmethod
    def fit(pts: DataFrame, n: int, contamination: float = 0.15, trees: int = 100, sample: int = 256, seed: int = 42):
        """``n`` is the number of points; the cut puts ``contamination`` of them outside."""
        size = min(sample, n)
        share = min(1.0, 1.5 * size / max(n, 1))  # rows offered per tree, then cut to ``size``
        limit = min(int(share * 2.0**63), 2**63 - 1)
        offered = F.filter(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.shiftrightunsigned(F.xxhash64(F.col("id"), t, F.lit(seed)), 1) <= limit,
        )
        depth = int(np.ceil(np.log2(max(size, 2))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "id"]).head(size)
            tree = int(pdf["tree"].iloc[0])
            rows = _grow(as_matrix(pdf["x"]), np.random.default_rng([seed, tree]), depth)
            return pd.DataFrame([(tree, *r) for r in rows], columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

        pool = pts.select("id", "x", F.explode(offered).alias("tree"))
        pool = pool.withColumn("h", F.xxhash64("id", "tree", F.lit(seed)))
        nodes = pool.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
        nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        raw = IsolationForest(nodes, size, 0.0)
        scored = raw.score(pts)
        cut = scored.agg(F.percentile_approx("decision", F.lit(contamination), F.lit(100000)).alias("c")).first()["c"]
        return IsolationForest(nodes, size, float(cut))

    def scorer(self, spark: SparkSession):
        """Matrix to decisions; below 0 is anomalous."""
        trees = [t.drop(columns="tree").to_numpy() for _, t in self.nodes.groupby("tree")]
        shared = spark.sparkContext.broadcast(trees)  # bounded by trees * (2 * sample - 1) nodes
        norm, offset = float(average_path(self.sample)) or 1.0, self.offset

        def decide(x: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x))
            for tree in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                feature = tree[:, 1].astype(np.int64)
                while True:
                    f = feature[at]
                    moving = np.flatnonzero(f >= 0)
                    if len(moving) == 0:
                        break
                    here = at[moving]
                    left = x[moving, f[moving]] <= tree[here, 2]
                    at[moving] = np.where(left, tree[here, 3], tree[here, 4]).astype(np.int64)
                total += tree[at, 5]
            return -np.power(2.0, -total / (len(shared.value) * norm)) - offset

        return decide

    def score(self, pts: DataFrame) -> DataFrame:
        return score_points(pts, {"decision": self.scorer(pts.sparkSession)})

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.sample, self.offset)], "sample int, offset double").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        meta = spark.read.parquet(f"{path}/meta").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        return IsolationForest(nodes, meta["sample"], meta["offset"])
