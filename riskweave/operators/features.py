"""The 23-feature vector and the derived discriminators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import scalars as S
from riskweave.operators.baselines import peer_deviation


def feature_columns(as_of: Column) -> dict[str, Column]:
    """Feature name to expression, in vector order. Needs activity and peer columns."""
    def number(c) -> Column:
        return c.cast("double") if isinstance(c, Column) else F.col(c).cast("double")

    count_30 = F.col("event_count_30d")
    own_mean, own_std = F.coalesce("peer_mean", F.lit(0.0)), F.coalesce("peer_std", F.lit(1.0))
    values = [
        number(S.days_since_login(as_of)),
        F.least(F.lit(1.0), S.permission_utilization()),
        number(F.size("roles")),
        number("systems_count"),
        F.col("role_changes_90d") / F.lit(90.0),
        number("is_privileged"),
        number(F.col("owner_id") != ""),
        number(F.lower("employment_status").startswith("terminat")),
        number("off_hours_access_pct"),
        number("geo_anomaly"),
        number("sso_linked"),
        number("mfa_enabled"),
        number(S.sensitivity_score(F.col("resource_sensitivity"))),
        F.when(own_std > 0, (count_30 - own_mean) / own_std).otherwise(F.lit(0.0)),
        number(S.account_age(as_of, unknown=0)),
        S.ratio(F.col("anomaly_event_count"), F.col("event_count_90d")),
        S.ratio(F.col("failed_attempt_count"), F.col("event_count_90d")),
        number("unique_resources_accessed"),
        number("bulk_download_detected"),
        number("impossible_travel_detected"),
        number("off_hours_event_pct"),
        peer_deviation(),
        number("avg_time_between_events_hours"),
    ]
    return dict(zip(fv.FEATURE_NAMES, values))


def feature_table(identities: DataFrame, as_of: Column, keep: list[str] | None = None) -> DataFrame:
    """One row per identity: ``user_id``, the kept columns, and the 23 features as doubles.

    Feature names that are also inventory columns keep the feature's value.
    """
    features = feature_columns(as_of)
    kept = [c for c in ["user_id", *(keep or [])] if c not in features]
    return identities.select(*kept, *[c.alias(n) for n, c in features.items()])


def discriminators() -> dict[str, Column]:
    """Products of raw features that separate risky from harmless accounts."""
    idle = F.col("days_since_login") / F.lit(999.0)
    privileged, unowned = F.col("is_privileged_flag"), 1 - F.col("has_owner_flag")
    ended, changes = F.col("hr_mismatch_flag"), F.col("role_change_velocity") * 90.0
    return {
        "disc_privileged": privileged,
        "disc_unowned": unowned,
        "disc_ended": ended,
        "disc_role_changes": changes,
        "disc_systems_without_sso": F.col("system_count") * (1 - F.col("sso_linked_flag")),
        "disc_privileged_idle": privileged * idle,
        "disc_privileged_unowned_idle": privileged * unowned * idle,
        "disc_privileged_ended_idle": privileged * ended * idle,
        "disc_privileged_creep": privileged * (changes >= 3).cast("double"),
        "disc_unowned_idle": idle * unowned,
    }
