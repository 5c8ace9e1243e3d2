"""Exfiltration alerts from export actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskweave import fixed_values as fv


def exfiltration_alerts(
    events: DataFrame, users: DataFrame, min_exports: int = 5, use_clock: bool = False
) -> DataFrame:
    """One alert per user with at least ``min_exports`` export events.

    After-hours means the event's time class; ``use_clock`` also counts UTC
    hours 0 to 5.
    """
    late = F.coalesce(F.col("time_classification").isin(fv.AFTER_HOURS_CLASSES), F.lit(False))
    if use_clock:
        late = late | F.coalesce(F.hour("ts") <= 5, F.lit(False))
    sensitivity = F.coalesce("resource_sensitivity", F.lit("low"))
    per_user = (
        events.where(F.lower("action").isin(fv.EXPORT_ACTIONS))
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_exports"),
            F.count_if(late).alias("after_hours_exports"),
            F.count_if(sensitivity.isin("critical", "high")).alias("sensitive_resource_count"),
            F.count_if(sensitivity == "critical").alias("critical_exports"),
        )
        .where(F.col("total_exports") >= min_exports)
    )
    weight = F.when(F.col("critical_exports") > 0, 4).otherwise(3)
    score = F.col("total_exports") + 2 * F.col("after_hours_exports") + F.col("sensitive_resource_count") * weight
    level = (
        F.when(score >= 30, "CRITICAL").when(score >= 20, "HIGH").when(score >= 10, "MEDIUM").otherwise("LOW")
    )
    text = F.concat(
        F.col("total_exports"), F.lit(" exports, "), F.col("after_hours_exports"), F.lit(" after hours, "),
        F.col("sensitive_resource_count"), F.lit(" sensitive; score "), score,
    )
    alerts = per_user.select(
        "user_id", level.alias("risk_level"), "total_exports", "after_hours_exports",
        "sensitive_resource_count", score.alias("exfiltration_score"), text.alias("description"),
    )
    return alerts.join(users.select("user_id", "username"), "user_id", "inner")
