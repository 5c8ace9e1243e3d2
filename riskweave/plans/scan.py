"""The full scan: inventory and event log in, one scored row per identity out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.operators import activity, baselines as B, context, features, remediation, rules, scoring
from riskweave.session import shared
from riskweave.thresholds import DEFAULTS, Thresholds

SCORED_COLUMNS = [
    "user_id", "username", "email", "department", "source_system", "score", "tier", "anomaly_types",
    "mitre_technique", "primary_rule", "suppressed_rule_count", "blast_radius_applied", "account_type",
    "employment_status", "mfa_enabled", "sso_linked", "last_login", "created_at", "roles", "permissions",
    "systems_count", "off_hours_access_pct", "is_privileged", "risk_narrative", "contributing_factors",
    "suppressed_factors", "context_signals", "mitre_techniques", "remediation_actions", "behavior_zscore",
    "confidence", "peer_deviation_score", "active_rules", "suppressed_rules", "resource_sensitivity",
]


def profiled_identities(
    users: DataFrame,
    events: DataFrame,
    thresholds: Thresholds = DEFAULTS,
    event_as_of=None,
    baselines: DataFrame | None = None,
    baseline_mode: str = "job_title",
) -> DataFrame:
    """Identities with activity, profile (``baseline_*``) and peer columns."""
    # the raw log is aggregated once; its cells and the per-user features have several readers
    cells = shared(activity.hourly_cells(events, thresholds, event_as_of))
    if baselines is None:
        own_key = {"department", "job_title"} <= set(events.columns)
        yearly = shared(B.year_cells(cells, None if own_key else users))
        baselines = B.profiles_from_cells(yearly, thresholds)
    active = shared(activity.user_activity(events, thresholds, event_as_of, cells=cells))
    people = activity.identities(users, active)
    peers = B.peer_stats(people)  # before the profiles are joined: the averages need none of them
    return B.attach_peers(B.attach_baseline(people, baselines, baseline_mode), peers)


def score_identities(
    people: DataFrame,
    as_of: Column,
    thresholds: Thresholds = DEFAULTS,
    extra_rules: list | None = None,
    conflicts: DataFrame | None = None,
) -> DataFrame:
    """Rules, signals, score and plan for profiled identities: projections only."""
    people = people.withColumns({
        "peer_deviation_score": B.peer_deviation(),
        "behavior_zscore": F.when(F.col("has_baseline"), B.behavior_zscore(as_of, thresholds)).otherwise(F.lit(0.0)),
    })
    people = rules.with_rules(people, as_of, thresholds, extra_rules, conflicts)
    people = context.with_context(people, as_of, thresholds)
    return remediation.with_remediation(scoring.with_scores(people, thresholds))


def full_scan(
    users: DataFrame,
    events: DataFrame,
    as_of: Column,
    thresholds: Thresholds = DEFAULTS,
    event_as_of=None,
    baselines: DataFrame | None = None,
    baseline_mode: str = "job_title",
    clusters: DataFrame | None = None,
    sequences: DataFrame | None = None,
) -> DataFrame:
    """One row per identity with every output column of the scan."""
    people = profiled_identities(users, events, thresholds, event_as_of, baselines, baseline_mode)
    out = score_identities(people, as_of, thresholds).select(*SCORED_COLUMNS)
    if clusters is not None:
        out = out.join(clusters.select("user_id", F.col("cluster_id").cast("string").alias("cluster_assignment")),
                       "user_id", "left").fillna("", ["cluster_assignment"])
    if sequences is not None:
        risk = F.struct("pattern_detected", "pattern_type", "sequence_confidence").alias("sequence_risk")
        out = out.join(sequences.select("user_id", risk), "user_id", "left")
    return out
