"""Holdout evaluation: split, train-only statistics, base models, stack, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.models.ensemble import AnomalyEnsemble
from riskweave.models.supervised import RiskClassifier, base_forests, fit_meta, positive_probability, stratified_holdout
from riskweave.models.vectors import Scaler
from riskweave.operators import activity, baselines as B, evaluation as E, features
from riskweave.plans.scan import score_identities
from riskweave.operators.rules import rule_flags
from riskweave.session import at_once, checkpointed
from riskweave.thresholds import DEFAULTS, Thresholds

CUT = 0.22


@dataclass(frozen=True)
class HoldoutResult:
    status: str
    label_match_count: int
    predictions: DataFrame | None = None   # test rows: user_id, department, probability, is_anomaly, label
    report: DataFrame | None = None        # long metric table


def holdout_features(users: DataFrame, events: DataFrame, labels: DataFrame, as_of: Column, thresholds: Thresholds, seed: int,
                     anomaly_types: list[str]) -> DataFrame:
    """One row per identity: label, is_test, 23 features, rule flags, discriminators, event mix.

    Peer statistics and baselines come from training users only; where none of
    them has an event the whole log is used.
    """
    people = E.align_labels(activity.identities(users, activity.user_activity(events, thresholds)), labels)
    people = checkpointed(stratified_holdout(people, "label", seed=seed))
    train_users = people.where(~F.col("is_test")).select("user_id")
    seen = events.select("user_id").distinct().join(train_users, "user_id", "left_semi")
    only = None if seen.isEmpty() else train_users
    profiles = B.build_baselines(events, None if "department" in events.columns else users, thresholds, only=only)
    profiled = B.attach_baseline(people, profiles, "role_then_department")
    profiled = B.attach_peers(profiled, B.peer_stats(people.where(~F.col("is_test"))))
    scored = score_identities(profiled, as_of, thresholds)
    flags = {f"rule_{r}": c.cast("double") for r, c in rule_flags().items()}
    vector = features.feature_columns(as_of)
    kept = ["user_id", "department", "label", "is_test"]
    # features that share a name with an identity column are computed before it is dropped
    table = scored.withColumns(flags).select(*kept, *flags, *[c.alias(n) for n, c in vector.items()])
    table = table.withColumns(features.discriminators())
    mix = activity.anomaly_mix(events, anomaly_types)
    filled = [c for c in mix.columns if c != "user_id"]
    return table.join(mix, "user_id", "left").fillna(0, subset=filled)


def run_holdout(
    users: DataFrame, events: DataFrame, labels: DataFrame, as_of: Column, thresholds: Thresholds = DEFAULTS,
    seed: int = 42, cut: float = CUT, anomaly_types: list[str] | None = None, check_auc: bool = True,
) -> HoldoutResult:
    labels = checkpointed(labels)  # read twice; they may come out of a scan
    state = E.evaluation_status(E.align_labels(users, labels)).first()  # one row
    if state["status"] != "ok":
        return HoldoutResult(state["status"], state["label_match_count"])
    types = activity.anomaly_types(events) if anomaly_types is None else anomaly_types
    table = checkpointed(holdout_features(users, events, labels, as_of, thresholds, seed, types))
    train = table.where(~F.col("is_test"))
    names = fv.FEATURE_NAMES
    anomalies, classifier, (bagged, extra) = at_once(
        table.sparkSession,
        lambda: AnomalyEnsemble.fit(train, names, contamination=0.20, seed=seed).predict(table),
        lambda: RiskClassifier.fit(train, names, seed=seed, check=check_auc),
        lambda: base_forests(train, names, seed=seed),
    )
    stacked = classifier.predict(table, "smote_probability")
    stacked = bagged.transform(stacked).withColumn("weighted_probability", positive_probability()).drop("x", "rawPrediction", "probability", "prediction")
    stacked = extra.predict(stacked, "extra_probability")
    stacked = stacked.join(anomalies.select("user_id", "anomaly_score"), "user_id")
    scaler = Scaler.fit(train, names)
    stacked = stacked.withColumns({f"scaled_{c}": v for c, v in zip(names, scaler.scaled())})
    inputs = (
        ["smote_probability", "weighted_probability", "extra_probability", "anomaly_score"]
        + [f"scaled_{c}" for c in names] + [f"rule_{r}" for r in fv.RULE_IDS] + list(features.discriminators())
        + ["anomaly_fraction", "event_total"] + [f"n_{t}" for t in types]
    )
    stacked = checkpointed(stacked)
    meta = fit_meta(stacked.where(~F.col("is_test")), inputs)
    judged = meta.transform(stacked.where("is_test")).select(
        "user_id", "department", "label", positive_probability().alias("probability"))
    judged = judged.withColumn("is_anomaly", (F.col("probability") >= cut).cast("int"))
    truth = judged.select("user_id", F.col("label").alias("is_anomaly"))
    report = E.metric_report(E.join_labels(judged.select("user_id", "department", "is_anomaly"), truth))
    return HoldoutResult("ok", state["label_match_count"], judged, report)
