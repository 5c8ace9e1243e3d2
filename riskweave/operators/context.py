"""Context signals that explain a finding, shift the score or mute rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions import scalars as S
from riskweave.operators.baselines import FINANCE, raw_zscore
from riskweave.thresholds import DEFAULTS, Thresholds


def _signal(name: str, when: str, why: str, confidence: float, points, mutes: tuple = (), followup: bool = False) -> str:
    """SQL text: the signal struct where ``when`` holds, else null."""
    muted = "array(" + ", ".join(f"'{m}'" for m in mutes) + ")"
    return (
        f"if(coalesce({when}, false), named_struct('signal_type', '{name}', 'explanation', {why}, "
        f"'confidence', {confidence}D, 'score_adjustment', {points}, 'rules_suppressed', cast({muted} as array<string>), "
        f"'requires_followup', {str(followup).lower()}), null)"
    )


def context_signals(t: Thresholds = DEFAULTS) -> Column:
    """Ordered array of the signals that apply; needs ``__idle``, ``__age``, ``__z`` and ``__day``."""
    elevated = f"role_changes_90d >= {t.temp_elevation_min}"
    if t.temp_elevation_max is not None:
        elevated += f" AND role_changes_90d <= {t.temp_elevation_max}"
    signals = [
        _signal("SABBATICAL_POSSIBLE",
                "__idle BETWEEN 30 AND 180 AND is_privileged AND employment_status = 'active' AND owner_id <> ''",
                "concat('idle for ', __idle, ' days, still active and owned; ask the manager about leave')",
                0.60, -10, followup=True),
        _signal("TEMP_ELEVATION", elevated, "'a recent role change explains a temporary rise in access'",
                0.75, -5, ("PRIVILEGE_CREEP", "LATERAL_MOVEMENT_SPIKE")),
        _signal("NEW_HIRE_RAMP",
                "has_baseline AND __age <= 30 AND systems_count > baseline_avg_unique_resources_30d",
                "concat('account opened ', __age, ' days ago, its access is still being set up')",
                0.80, -10, ("OVER_PRIVILEGED",)),
        _signal("BATCH_JOB_PATTERN",
                "has_baseline AND account_type = 'service' AND off_hours_access_pct > 0.70D "
                "AND NOT interactive_login AND event_count_30d > 20 AND __z < 2.0D",
                "'steady off-hours automation; compare with the job schedule'",
                0.80, -15, ("SERVICE_ACCT_ABUSE",)),
        _signal("MONTH_END_FINANCE",
                f"has_baseline AND department = '{FINANCE}' AND __z > 2.0D AND __day >= {t.month_end_day}",
                "concat('month-end close, usual surge ', format_number(baseline_month_end_multiplier, 1), 'x')",
                0.90, -20, ("EXCESSIVE_ACCESS",)),
        _signal("IMPOSSIBLE_TRAVEL_CONFIRMED", "impossible_travel_detected OR cross_system_impossible_travel",
                "if(cross_system_impossible_travel, 'distant regions within hours, seen by two systems', "
                "'distant regions within hours')",
                0.95, "if(cross_system_impossible_travel, 30, 25)"),
        _signal("CONTRACTOR_NORM", "employment_status = 'contractor' AND off_hours_access_pct > 0.30D",
                "'contractors often work off-hours; compare with the contract'", 0.70, 0),
    ]
    return F.expr("filter(array(" + ", ".join(signals) + "), s -> s IS NOT NULL)")


def with_context(identities: DataFrame, as_of: Column, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    staged = identities.withColumns({
        "__idle": S.days_since_login(as_of),
        "__age": S.account_age(as_of, unknown=365),
        "__z": raw_zscore(),
        "__day": F.dayofmonth(as_of),
    })
    return staged.withColumn("context_signals", context_signals(thresholds)).drop("__idle", "__age", "__z", "__day")


SUPPRESSED_RULE_IDS = "array_distinct(flatten(transform(context_signals, s -> s.rules_suppressed)))"
