"""Peer access rates and the access decision they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.salting import salted_left_join

GRANT = ["department", "resource", "action"]


def _memberships(events: DataFrame, users: DataFrame | None) -> DataFrame:
    """Distinct (user, department), from the log or from the inventory for users in the log."""
    if users is None:
        return events.select("user_id", "department").distinct()
    seen = events.select("user_id").distinct()
    return users.select("user_id", "department").join(seen, "user_id", "left_semi").distinct()


def peer_access_rates(events: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Share of a department's users who did an action on a resource, for all combinations seen.

    Events shrink to distinct (user, resource, action) before anything is
    joined, so a busy account counts once per grant however often it acts.
    """
    members = _memberships(events, users)
    size = members.groupBy("department").agg(F.count(F.lit(1)).alias("peers"))
    grants = events.select("user_id", "resource", "action").distinct()
    used = grants.join(members, "user_id").groupBy(*GRANT).agg(F.count(F.lit(1)).alias("users_with_access"))
    rated = salted_left_join(used, size, ["department"], F.hash("resource", "action"))
    return rated.withColumn("peer_access_rate", F.col("users_with_access") / F.col("peers"))


def decision_columns(rate: Column) -> dict[str, Column]:
    percent = F.concat(F.rint(rate * 100).cast("int"), F.lit("%"))
    grant = F.concat_ws("/", "resource", "action")
    return {
        "decision": F.when(rate > 0.80, "APPROVE").when(rate > 0.40, "REVIEW").otherwise("DENY"),
        "confidence": F.when(rate > 0.80, 0.95).when(rate > 0.40, 0.65).when(rate > 0.0, 0.80).otherwise(0.90),
        "peer_comparison_note": F.when(
            rate > 0, F.concat(percent, F.lit(" of "), F.col("department"), F.lit(" use "), grant)
        ).otherwise(F.concat(F.lit("nobody in "), F.col("department"), F.lit(" uses "), grant)),
    }


def access_decisions(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """Decision, confidence and note for every request (department, resource, action, ...)."""
    # many requests may ask for one grant: spread them over the salts by their content
    joined = salted_left_join(
        requests, rates.select(*GRANT, "peer_access_rate"), GRANT, F.xxhash64(*requests.columns)
    ).fillna(0.0, ["peer_access_rate"])
    return joined.withColumns(decision_columns(F.col("peer_access_rate")))
