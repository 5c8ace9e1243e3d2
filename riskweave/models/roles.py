"""Role mining: access matrix, k-means with a silhouette choice, profiles and outliers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskweave.functions.numbering import numbered
from riskweave.models.kmeans import STARTS, Fitted, Rows, fit_many
from riskweave.session import checkpointed

MAX_CLUSTERS, DEFAULT_CLUSTERS, MIN_SILHOUETTE = 15, 8, 0.35
ACTION_DIVERSITY = "action_diversity"


def grant_counts(events: DataFrame) -> DataFrame:
    """Events per (user, resource, action): what every later step works on."""
    return events.groupBy("user_id", "resource", "action").agg(F.count(F.lit(1)).alias("n"))


def access_matrix(events: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(user_id, feature, share): the sparse access matrix, rows divided by the user's event total.

    Features are the resources, the number of distinct actions, and the
    department (the first by name where the log has several for one user).
    """
    counts = grant_counts(events)
    totals = counts.groupBy("user_id").agg(F.sum("n").alias("total"), F.count_distinct("action").alias("actions"))
    resources = counts.where("resource is not null").groupBy("user_id", F.col("resource").alias("feature")).agg(F.sum("n").alias("value"))
    diversity = totals.select("user_id", F.lit(ACTION_DIVERSITY).alias("feature"), F.col("actions").alias("value"))
    if users is None and "department" in events.columns:
        homes = events.groupBy("user_id").agg(F.min("department").alias("department"))
    elif users is not None:
        homes = users.select("user_id", "department").join(totals.select("user_id"), "user_id", "left_semi")
    else:
        homes = None
    cells = resources.unionByName(diversity)
    if homes is not None:
        cells = cells.unionByName(homes.select(
            "user_id", F.concat(F.lit("department_"), F.coalesce("department", F.lit(""))).alias("feature"),
            F.lit(1).cast("bigint").alias("value")))
    return cells.join(totals.select("user_id", "total"), "user_id").select(
        "user_id", "feature", (F.col("value") / F.col("total")).alias("share"))


def vocabulary(matrix: DataFrame) -> DataFrame:
    """(feature, i): every feature's place, dense and in the order of the names."""
    return numbered(matrix.select("feature").distinct().orderBy("feature"), "i")


def access_vectors(matrix: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(user_id, at, value): one sparse row per user, over ``places`` (by default the vocabulary of ``matrix``).

    Features get exact places, so none share one; features that ``places`` doesn't have are left out.
    """
    placed = matrix.join(places if places is not None else vocabulary(matrix), "feature")
    entries = placed.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "share"))).alias("e"))
    return entries.select("user_id", F.col("e.i").alias("at"), F.col("e.share").alias("value"))  # at most a user's features


@dataclass(frozen=True)
class RoleModel:
    """k-means centres in deviation-scaled space, and the places of the features. Distances need no centring, so rows stay sparse."""

    centres: np.ndarray
    deviations: np.ndarray
    places: DataFrame  # feature, i

    def scaled(self, vectors: DataFrame) -> DataFrame:
        """(id, at, value) in deviations; a constant feature is zero."""
        held = vectors.sparkSession.sparkContext.broadcast(np.where(self.deviations > 0, self.deviations, np.inf))

        def divide(batches):
            for pdf in batches:
                yield pdf.assign(value=[np.asarray(v) / held.value[np.asarray(a, int)] for a, v in zip(pdf["at"], pdf["value"])])

        id_type = vectors.schema["user_id"].dataType.simpleString()
        return vectors.withColumnRenamed("user_id", "id").mapInPandas(divide, f"id {id_type}, at array<int>, value array<double>")

    def save(self, path: str) -> None:
        spark = self.places.sparkSession
        self.places.write.mode("overwrite").parquet(f"{path}/places")
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(self.centres)], "k int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
        spark.createDataFrame([(self.deviations.tolist(),)], "deviations array<double>").write.mode("overwrite").parquet(f"{path}/deviations")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RoleModel":
        centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("k").collect()]
        deviations = spark.read.parquet(f"{path}/deviations").first()["deviations"]
        return RoleModel(np.array(centres), np.array(deviations), spark.read.parquet(f"{path}/places"))


def fit_roles(matrix: DataFrame, max_clusters: int = MAX_CLUSTERS, min_silhouette: float = MIN_SILHOUETTE,
              starts: int = STARTS, seed: int = 42) -> tuple[RoleModel, DataFrame]:
    """The model with the best silhouette, and the users' scaled rows (id, at, value).

    Of each number of clusters the best of ``starts`` is taken. Below the silhouette cut the
    default number of clusters is used. What the driver holds are centres and deviations:
    numbers of clusters and starts times the vocabulary.
    """
    places = checkpointed(vocabulary(matrix))
    vectors = checkpointed(access_vectors(matrix, places))
    users, width = vectors.count(), places.count()
    spread = vectors.select(F.explode(F.arrays_zip("at", "value")).alias("e")).groupBy("e.at").agg(
        F.sum("e.value").alias("s"), F.sum(F.col("e.value") * F.col("e.value")).alias("q")).toPandas()
    deviations = np.zeros(width)
    mean, square = spread["s"].to_numpy(float) / max(users, 1), spread["q"].to_numpy(float) / max(users, 1)
    deviations[spread["at"].to_numpy(int)] = np.sqrt(np.maximum(square - mean**2, 0.0))
    deviations[deviations < 1e-12] = 0.0
    model = RoleModel(np.zeros((0, width)), deviations, places)
    scaled = checkpointed(model.scaled(vectors))
    most = min(max_clusters, users - 1)
    fitted = fit_many(scaled, width, sorted({*range(2, most + 1), min(DEFAULT_CLUSTERS, max(users, 1))}), starts, seed)
    split = {k: f for k, f in fitted.items() if k <= most and (f.sizes > 0).sum() >= 2}
    best = max(split, key=lambda k: (split[k].silhouette, -k), default=None)
    if best is None or split[best].silhouette <= min_silhouette:
        few = [k for k in fitted if k <= DEFAULT_CLUSTERS]
        best = max(few, default=None)
    chosen = fitted[best].centres if best is not None else fit_many(scaled, width, [1], 1, seed).get(1, Fitted(np.zeros((1, width)), 0.0, 0.0, np.zeros(1))).centres
    return RoleModel(chosen, deviations, places), scaled


def assign_roles(model: RoleModel, scaled: DataFrame) -> DataFrame:
    """(user_id, cluster_id, distance, is_outlier): beyond mean + 2 deviations of its cluster."""
    held = scaled.sparkSession.sparkContext.broadcast((model.centres, np.ascontiguousarray(model.centres.T)))

    def measure(batches):
        for pdf in batches:
            away = Rows.of(pdf).distances(*held.value)
            cluster = away.argmin(axis=1)
            yield pd.DataFrame({"user_id": pdf["id"], "cluster_id": cluster, "distance": np.sqrt(away[np.arange(len(pdf)), cluster])})

    id_type = scaled.schema["id"].dataType.simpleString()
    measured = scaled.mapInPandas(measure, f"user_id {id_type}, cluster_id int, distance double")
    limits = measured.groupBy("cluster_id").agg((F.avg("distance") + 2 * F.stddev_pop("distance")).alias("limit"))
    joined = measured.join(F.broadcast(limits), "cluster_id")  # one row per cluster
    return joined.select("user_id", "cluster_id", "distance", (F.col("distance") > F.col("limit")).alias("is_outlier"))


def profile_roles(assigned: DataFrame, matrix: DataFrame, counts: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One row per cluster: label, size, top resources and actions, mean risk, outliers."""
    size = assigned.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("user_count"), F.count_if("is_outlier").alias("outlier_count"))
    home = assigned.select("user_id", "cluster_id")
    resources = matrix.where((F.col("feature") != ACTION_DIVERSITY) & ~F.col("feature").startswith("department_"))
    weight = resources.join(home, "user_id").groupBy("cluster_id", "feature").agg(F.sum("share").alias("w"))
    actions = counts.join(home, "user_id").groupBy("cluster_id", "action").agg(F.sum("n").alias("w"))
    out = size.join(_top(weight, "feature", "dominant_resources"), "cluster_id", "left").join(
        _top(actions, "action", "dominant_actions"), "cluster_id", "left")
    if scored is not None:
        risk = home.join(scored.select("user_id", "score"), "user_id", "left")
        out = out.join(risk.groupBy("cluster_id").agg(F.avg(F.coalesce("score", F.lit(0))).alias("avg_risk_score")), "cluster_id", "left")
    else:
        out = out.withColumn("avg_risk_score", F.lit(0.0))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("unknown"))
    return out.withColumn("label", F.concat_ws("_", first("dominant_resources"), first("dominant_actions")))


def _top(weights: DataFrame, value: str, name: str, k: int = 3) -> DataFrame:
    order = W.partitionBy("cluster_id").orderBy(F.desc("w"), value)
    ranked = weights.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    pairs = F.array_sort(F.collect_list(F.struct("place", value)))
    return ranked.groupBy("cluster_id").agg(F.transform(pairs, lambda p: p[value]).alias(name))
