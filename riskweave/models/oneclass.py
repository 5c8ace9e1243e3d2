"""One-class boundary with an RBF kernel, as a linear model over random Fourier features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.models.vectors import as_matrix, score_points


def _projection(features: int, width: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (features, width)), rng.uniform(0.0, 2.0 * np.pi, width)


def _lift(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / w.shape[1]) * np.cos(x @ w + b)


def _vector_sum(pts: DataFrame, per_batch) -> np.ndarray:
    """Sum of one fixed-length vector per batch over the whole table."""
    def run(batches):
        for pdf in batches:
            v = per_batch(as_matrix(pdf["x"]))
            yield pd.DataFrame({"i": np.arange(len(v)), "v": v})

    rows = pts.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row per entry
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


@dataclass(frozen=True)
class OneClassBoundary:
    weights: np.ndarray
    rho: float
    features: int
    gamma: float
    seed: int

    @staticmethod
    def fit(pts: DataFrame, n: int, features: int, nu: float = 0.05, width: int = 256, steps: int = 8, seed: int = 42):
        """Frank-Wolfe on the one-class dual over all points.

        The weights stay a mean of lifted points. Each step moves them towards
        the mean of the ``nu`` share with the lowest score, found by a quantile;
        both are one distributed pass.
        """
        gamma = 1.0 / features
        w, b = _projection(features, width, gamma, seed)
        lift = lambda x: _lift(x, w, b)
        weights = _vector_sum(pts, lambda x: lift(x).sum(axis=0)) / max(n, 1)
        for step in range(steps):
            current = weights
            cut = OneClassBoundary(current, 0.0, features, gamma, seed)._quantile(pts, nu)

            def lowest(x: np.ndarray) -> np.ndarray:
                phi = lift(x)
                low = phi @ current <= cut
                return np.append(phi[low].sum(axis=0), low.sum())

            total = _vector_sum(pts, lowest)
            rate = 2.0 / (step + 3)
            weights = (1 - rate) * weights + rate * total[:-1] / max(total[-1], 1.0)
        model = OneClassBoundary(weights, 0.0, features, gamma, seed)
        return OneClassBoundary(weights, model._quantile(pts, nu), features, gamma, seed)

    def _quantile(self, pts: DataFrame, q: float) -> float:
        return float(self.score(pts).agg(F.percentile_approx("decision", F.lit(q), F.lit(100000)).alias("c")).first()["c"])

    def scorer(self, spark: SparkSession | None = None):
        """Matrix to decisions; below 0 is outside the boundary."""
        weights, rho = self.weights, self.rho
        w, b = _projection(self.features, len(weights), self.gamma, self.seed)
        return lambda x: _lift(x, w, b) @ weights - rho

    def score(self, pts: DataFrame) -> DataFrame:
        return score_points(pts, {"decision": self.scorer()})

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.weights.tolist(), self.rho, self.features, self.gamma, self.seed)
        spark.createDataFrame([row], "weights array<double>, rho double, features int, gamma double, seed int").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "OneClassBoundary":
        r = spark.read.parquet(path).first()
        return OneClassBoundary(np.array(r["weights"]), r["rho"], r["features"], r["gamma"], r["seed"])
