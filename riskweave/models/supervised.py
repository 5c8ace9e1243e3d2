"""Risk classifier, oversampling, access predictor and the stacked holdout model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.placing import hashed_position
from riskweave.models.extra_trees import ExtraTrees
from riskweave.models.neighbours import PointIndex, distinct_points, neighbours_among
from riskweave.session import at_once, checkpointed

MIN_AUC = 0.75
#: Trees outside the risk classifier grow as deep as the library allows.
MOST_DEPTH = 30
#: Synthetic rows made at a time.
GROWN_ROWS = 4096
ACCESS_FEATURES = ["department", "job_title", "resource", "action"]


class ModelQualityError(ValueError):
    """The fitted model ranks held-out rows too poorly."""

    def __init__(self, auc: float) -> None:
        super().__init__(f"AUC {auc:.4f} is below {MIN_AUC:.2f}")
        self.auc = auc


def stratified_holdout(table: DataFrame, label: str = "label", share: float = 0.20, seed: int = 42, id_column: str = "user_id") -> DataFrame:
    """Adds ``is_test``: exactly the floor of the share of each class, chosen by hashed id."""
    placed = hashed_position(table, [label], id_column, seed)
    test = F.col("position") <= F.floor(F.col("group_rows") * share)
    return placed.withColumn("is_test", test).drop("position", "group_rows")


def smote(train: DataFrame, features: list[str], label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """Adds synthetic minority rows until both classes have the same size.

    A new row lies between a minority row and one of its ``k`` nearest other minority rows;
    neighbours are looked up in all of them.
    """
    sizes = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    positives, missing = sizes["p"], sizes["n"] - sizes["p"]
    if positives < 2 or missing <= 0:
        return train
    minority = train.where(F.col(label) == 1).select(F.col("user_id").alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    found = distinct_points(minority)
    near = neighbours_among(found, PointIndex.build(found), min(k, positives - 1))
    near = near.join(found.select(F.col("pid").alias("p"), F.col("x").alias("partner")), "p")
    partners = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "p", "taken", "partner"))).alias("near"))  # at most k
    partners = found.join(partners, F.col("pid") == F.col("q")).select("x", F.expr("flatten(transform(near, s -> array_repeat(s.partner, cast(s.taken AS int))))").alias("partners"))
    each, rest = divmod(missing, positives)

    def grow(batches):
        for pdf in batches:
            for point, others, key, name, position in zip(pdf["x"], pdf["partners"], pdf["key"], pdf["id"], pdf["position"]):
                rng = np.random.default_rng([seed, int(key) & 0x7FFFFFFFFFFFFFFF])
                n = each + int(position <= rest)
                for first in range(0, n, GROWN_ROWS):
                    some = min(GROWN_ROWS, n - first)
                    chosen = np.stack(others)[rng.integers(len(others), size=some)]
                    made = point + rng.random((some, 1)) * (chosen - point)
                    yield pd.DataFrame({"user_id": [f"synthetic-{name}-{first + i}" for i in range(some)], "x": list(made)})

    placed = hashed_position(minority.withColumn("__one", F.lit(1)), ["__one"], "id", seed)
    keyed = placed.select("id", "x", "position", F.xxhash64("id", F.lit(seed)).alias("key")).join(partners, "x")
    features_of = [F.get("x", F.lit(i)).alias(c) for i, c in enumerate(features)]
    made = keyed.mapInPandas(grow, "user_id string, x array<double>").select("user_id", *features_of, F.lit(1).alias(label))
    kept = train.select(F.col("user_id").cast("string").alias("user_id"), *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias(label))
    return kept.unionByName(made)


def positive_probability(c: str = "probability") -> Column:
    return vector_to_array(F.col(c))[1]


def class_weight(label: str, table: DataFrame) -> Column:
    """Weights that give both classes the same total."""
    r = table.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    n, p = float(r["n"]), float(r["p"] or 0)
    return F.when(F.col(label) == 1, n / (2 * max(p, 1.0))).otherwise(n / (2 * max(n - p, 1.0)))


@dataclass(frozen=True)
class RiskClassifier:
    model: PipelineModel
    features: tuple[str, ...]
    auc: float

    @staticmethod
    def fit(train: DataFrame, features: list[str], label: str = "label", seed: int = 42, check: bool = True) -> "RiskClassifier":
        """Forest of 100 trees of depth 10; oversampled where positives are under a fifth."""
        share = train.agg(F.avg(F.col(label).cast("double")).alias("s")).first()["s"] or 0.0
        rows = smote(train, features, label, seed=seed) if share < 0.20 else train.select("user_id", *features, label)
        split = checkpointed(stratified_holdout(rows, label, seed=seed))
        pipeline = Pipeline(stages=[
            VectorAssembler(inputCols=list(features), outputCol="x"),
            RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=100, maxDepth=10, seed=seed),
        ])
        model = pipeline.fit(split.where(~F.col("is_test")))
        auc = BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(split.where("is_test")))
        if check and auc < MIN_AUC:
            raise ModelQualityError(auc)
        return RiskClassifier(model, tuple(features), auc)

    def predict(self, table: DataFrame, name: str = "risk_probability") -> DataFrame:
        return self.model.transform(table).withColumn(name, positive_probability()).drop("x", "rawPrediction", "probability", "prediction")

    def top_features(self, n: int = 3) -> list[tuple[str, float]]:
        weights = self.model.stages[-1].featureImportances.toArray()
        return sorted(zip(self.features, map(float, weights)), key=lambda p: -p[1])[:n]

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str, features: list[str]) -> "RiskClassifier":
        return RiskClassifier(PipelineModel.load(path), tuple(features), float("nan"))


def fit_access_predictor(decided: DataFrame, label: str = "decision", seed: int = 42) -> PipelineModel:
    """Three-class forest over the request's fields and its peer access rate."""
    indexed = [f"{c}_i" for c in ACCESS_FEATURES]
    coded = [f"{c}_v" for c in ACCESS_FEATURES]
    return Pipeline(stages=[
        StringIndexer(inputCols=ACCESS_FEATURES, outputCols=indexed, handleInvalid="keep"),
        # an unseen value gets the last index, which the encoder drops to zeros
        OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="error", dropLast=True),
        VectorAssembler(inputCols=coded + ["peer_access_rate"], outputCol="x"),
        StringIndexer(inputCol=label, outputCol="decision_i", handleInvalid="skip", stringOrderType="alphabetAsc"),
        RandomForestClassifier(featuresCol="x", labelCol="decision_i", numTrees=100, maxDepth=MOST_DEPTH, seed=seed),
    ]).fit(decided)


def predict_access(model: PipelineModel | None, requests: DataFrame) -> DataFrame:
    """Decision and confidence per request; without a model everything is for review."""
    if model is None:
        return requests.withColumns({"predicted_decision": F.lit("REVIEW"), "predicted_confidence": F.lit(0.5)})
    labels = F.array(*[F.lit(x) for x in model.stages[3].labels])
    staged = requests
    for stage in (*model.stages[:3], model.stages[4]):
        staged = stage.transform(staged)
    return staged.select(
        *requests.columns, F.get(labels, F.col("prediction").cast("int")).alias("predicted_decision"),
        F.array_max(vector_to_array("probability")).alias("predicted_confidence"))


def save_access_predictor(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_access_predictor(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def base_forests(train: DataFrame, features: list[str], label: str = "label", seed: int = 42) -> tuple[PipelineModel, ExtraTrees]:
    """The two class-weighted base models: a bagged forest, and extremely randomised trees."""
    weighted = train.withColumn("w", class_weight(label, train))
    bagged = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="x"),
        RandomForestClassifier(featuresCol="x", labelCol=label, weightCol="w", numTrees=100, maxDepth=MOST_DEPTH, featureSubsetStrategy="sqrt", seed=seed,
                               cacheNodeIds=True),
    ])
    return tuple(at_once(train.sparkSession, lambda: bagged.fit(weighted), lambda: ExtraTrees.fit(train, features, label, seed=seed)))


def fit_meta(train: DataFrame, inputs: list[str], label: str = "label", c: float = 0.5) -> PipelineModel:
    """Logistic regression over the stacked inputs; ``c`` is the inverse penalty of the summed loss."""
    n = max(train.count(), 1)
    return Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="stack"),
        LogisticRegression(featuresCol="stack", labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0,
                           standardization=False, maxIter=1000),
    ]).fit(train)
