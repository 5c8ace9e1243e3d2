"""Three anomaly detectors, one vote and one score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.models.isolation import IsolationForest
from riskweave.models.lof import LocalOutlierFactor
from riskweave.models.oneclass import OneClassBoundary
from riskweave.models.vectors import Scaler, score_points
from riskweave.session import at_once, checkpointed, shared

DETECTORS = ["isolation", "boundary", "density"]


@dataclass(frozen=True)
class AnomalyEnsemble:
    scaler: Scaler
    isolation: IsolationForest
    boundary: OneClassBoundary
    density: LocalOutlierFactor

    @staticmethod
    def fit(table: DataFrame, features: list[str], contamination: float = 0.15, nu: float = 0.05, seed: int = 42):
        """Fits scaler and detectors on the rows of ``table`` (give training rows only)."""
        scaler = Scaler.fit(table, features)
        pts = checkpointed(scaler.points(table))
        n = pts.count()
        return AnomalyEnsemble(scaler, *at_once(
            table.sparkSession,
            lambda: IsolationForest.fit(pts, n, contamination, seed=seed),
            lambda: OneClassBoundary.fit(pts, n, len(features), nu, seed=seed),
            lambda: LocalOutlierFactor.fit(pts, n, contamination),
        ))

    def decisions(self, table: DataFrame) -> DataFrame:
        """(user_id, isolation, boundary, density): raw decisions, below 0 is anomalous. Expects one row a user."""
        pts = checkpointed(self.scaler.points(table))
        scorers = {name: getattr(self, name).scorer(table.sparkSession) for name in DETECTORS[:2]}
        density = self.density.score(pts).withColumnRenamed("decision", "density")
        return score_points(pts, scorers).join(density, "id").withColumnRenamed("id", "user_id")

    def predict(self, table: DataFrame) -> DataFrame:
        """(user_id, detector decisions, is_anomaly, anomaly_score)."""
        return vote(self.decisions(table))

    def save(self, spark: SparkSession, path: str) -> None:
        s = self.scaler
        spark.createDataFrame([(list(s.features), list(s.means), list(s.deviations))],
                              "features array<string>, means array<double>, deviations array<double>").write.mode("overwrite").parquet(f"{path}/scaler")
        for name in DETECTORS:
            getattr(self, name).save(spark, f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyEnsemble":
        s = spark.read.parquet(f"{path}/scaler").first()
        return AnomalyEnsemble(
            Scaler(tuple(s["features"]), tuple(s["means"]), tuple(s["deviations"])),
            IsolationForest.load(spark, f"{path}/isolation"), OneClassBoundary.load(spark, f"{path}/boundary"),
            LocalOutlierFactor.load(spark, f"{path}/density"),
        )


def vote(decisions: DataFrame) -> DataFrame:
    """Anomalous when two of three agree; the score is the mean of the scaled decisions."""
    decisions = shared(decisions)
    bounds = decisions.agg(F.struct(*[
        f(F.col(c)).alias(f"{c}_{n}") for c in DETECTORS for n, f in (("low", F.min), ("high", F.max))
    ])).scalar()

    def scaled(c: str) -> Column:
        low, high = bounds[f"{c}_low"], bounds[f"{c}_high"]
        return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((high - F.col(c)) / (high - low))

    votes = sum((F.col(c) < 0).cast("int") for c in DETECTORS)
    score = sum(scaled(c) for c in DETECTORS) / F.lit(3.0)
    return decisions.select("user_id", *DETECTORS, (votes >= 2).alias("is_anomaly"), score.alias("anomaly_score"))
