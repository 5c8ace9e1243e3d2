"""Local outlier factor in novelty mode: fitted once, then every row is scored against the fit set.

The fit set is the whole table at every size. Neighbours come from ``neighbours.PointIndex``;
k-distance, reachability and density are joins and aggregates on its (point, neighbour) rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.models.neighbours import PointIndex, distinct_points, fewer, nearest, neighbours_among, others
from riskweave.session import checkpointed

__all__ = ["LocalOutlierFactor", "nearest", "weighted_quantile"]

BINS = 1000


def weighted_quantile(values: DataFrame, share: float) -> float:
    """Quantile of ``v`` with ``n`` rows each, linear between neighbours, as of the sorted rows.

    Narrows the range by counts of equal bins until few values are left; no sort, and at
    most ``BINS`` rows reach the driver at a time.
    """
    r = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n")).first()
    if not r["n"]:
        return 0.0
    place = share * (r["n"] - 1)

    def value_at(rank: int) -> float:
        low, high, left = r["low"], r["high"], rank
        while low < high:
            at = F.least(F.floor((F.col("v") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
            bins = values.where(F.col("v").between(low, high)).groupBy(at.alias("at")).agg(
                F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("at").collect()
            if len(bins) == 1 and (bins[0]["low"], bins[0]["high"]) == (low, high):
                return low  # as near as doubles get
            for b in bins:
                if left < b["n"]:
                    low, high = b["low"], b["high"]
                    break
                left -= b["n"]
        return low

    lower = value_at(int(np.floor(place)))
    upper = value_at(int(np.ceil(place))) if place % 1 else lower
    return float(lower + (upper - lower) * (place % 1))


def _density(near: DataFrame, k_distance: DataFrame) -> DataFrame:
    """(q, density) from neighbours and the k-distances (p, k_distance) of the fitted points."""
    reach = F.col("taken") * F.greatest("d", "k_distance")
    return near.join(k_distance, "p").groupBy("q").agg((1.0 / (F.sum(reach) / F.sum("taken") + 1e-10)).alias("density"))


def _factor(near: DataFrame, own: DataFrame, fitted: DataFrame) -> DataFrame:
    """(q, factor): the neighbours' mean density over the own; above 1 is sparser than around."""
    around = near.join(fitted.select("p", F.col("density").alias("of_p")), "p")
    around = around.groupBy("q").agg((F.sum(F.col("taken") * F.col("of_p")) / F.sum("taken")).alias("around"))
    return around.join(own, "q").select("q", (F.col("around") / F.col("density")).alias("factor"))


def k_distances(pts: DataFrame, k: int = 20) -> DataFrame:
    """(id, k_distance) of every row: how far its ``k``-th nearest other row lies."""
    points = distinct_points(pts)
    far = neighbours_among(points, PointIndex.build(points), k).groupBy("q").agg(F.max("d").alias("k_distance"))
    return pts.join(points.join(far, F.col("pid") == F.col("q")).select("x", "k_distance"), "x").select("id", "k_distance")


@dataclass(frozen=True)
class LocalOutlierFactor:
    index: PointIndex
    fitted: DataFrame  # p, k_distance, density of each distinct point
    k: int
    offset: float
    near: DataFrame | None = None  # q, p, d, taken: neighbours of each distinct point, itself among them; not saved

    @staticmethod
    def fit(pts: DataFrame, n: int, contamination: float = 0.15, k: int = 20) -> "LocalOutlierFactor":
        points = distinct_points(pts)
        index = PointIndex.build(points)
        k = max(1, min(k, n - 1))
        found = index.nearest(points.select(F.col("pid").alias("q"), "x"), k + 1)
        near = others(found)
        k_distance = near.groupBy("q").agg(F.max("d").alias("k_distance")).withColumnRenamed("q", "p")
        own = _density(near, k_distance)
        fitted = checkpointed(own.withColumnRenamed("q", "p").join(k_distance, "p").select("p", "k_distance", "density"))
        own = fitted.select(F.col("p").alias("q"), "density")
        factors = checkpointed(_factor(near, own, fitted).join(points.select(F.col("pid").alias("q"), "n"), "q"))
        offset = weighted_quantile(factors.select((-F.col("factor")).alias("v"), "n"), contamination)
        return LocalOutlierFactor(index, fitted, k, offset, found)

    def score(self, pts: DataFrame) -> DataFrame:
        """(id, decision) of every row; below 0 is sparser than its neighbours."""
        asked = distinct_points(pts)
        near = self._near(asked)
        factors = _factor(near, _density(near, self.fitted), self.fitted)
        known = asked.join(factors, asked["pid"] == factors["q"], "left").select("x", "factor")
        # copies of one vector are split over tasks by the adaptive skew join
        return pts.join(known, "x", "left").select("id", (-F.coalesce("factor", F.lit(1.0)) - self.offset).alias("decision"))

    def _near(self, asked: DataFrame) -> DataFrame:
        """(q, p, d, taken): the ``k`` nearest fitted rows of each point; those of a fitted point were found by the fit,
        unless several are equally far for the last place."""
        if self.near is None:
            return self.index.nearest(asked.select(F.col("pid").alias("q"), "x"), self.k)
        own = self.index.points.select(F.col("pid").alias("fitted"), "x")
        placed = asked.select(F.col("pid").alias("asked"), "x").join(own, "x", "left")
        held, shared = fewer(self.near, self.k)
        placed = checkpointed(placed.join(shared.withColumnRenamed("q", "fitted"), "fitted", "left"))
        again = F.col("fitted").isNull() | F.coalesce("shared", F.lit(False))
        held = placed.where(~again).join(held, F.col("fitted") == F.col("q")).select(F.col("asked").alias("q"), "p", "d", "taken")
        new = placed.where(again).select(F.col("asked").alias("q"), "x")
        return held if new.isEmpty() else held.unionByName(self.index.nearest(new, self.k))

    def save(self, spark: SparkSession, path: str) -> None:
        self.index.save(path)
        self.fitted.write.mode("overwrite").parquet(f"{path}/fitted")
        spark.createDataFrame([(self.k, self.offset, len(self.index.levels))], "k int, offset double, levels int").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LocalOutlierFactor":
        meta = spark.read.parquet(f"{path}/meta").first()
        return LocalOutlierFactor(PointIndex.load(spark, path, meta["levels"]), spark.read.parquet(f"{path}/fitted"), meta["k"], meta["offset"])
