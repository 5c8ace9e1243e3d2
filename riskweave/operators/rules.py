"""The access-risk rules as SQL expressions in one ordered registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import scalars as S
from riskweave.thresholds import DEFAULTS, Thresholds

HOLDS_ADMIN_PERMISSION = "exists(permissions, p -> contains(lower(p), 'admin'))"


@dataclass(frozen=True)
class Rule:
    """One rule over identity columns: SQL text for its condition and its evidence.

    ``__idle`` (days since login), ``__utilization``, ``__anomaly_rate`` and
    ``sod_conflicts`` are on the row too. Severity is a name, or SQL text after ``=``.
    """

    rule_id: str
    condition: str
    evidence: str
    severity: str = "MEDIUM"

    def result(self) -> str:
        fired = f"coalesce({self.condition}, false)"
        severity = self.severity[1:] if self.severity.startswith("=") else f"'{self.severity}'"
        return (
            f"named_struct('rule_id', '{self.rule_id}', 'severity', {severity}, 'triggered', {fired}, "
            f"'evidence', if({fired}, {self.evidence}, ''), 'suppressed_by', cast(null as string))"
        )


def sod_array() -> Column:
    """The fixed conflict pairs as one array column, worst first."""
    ordered = sorted(fv.SOD_CONFLICTS, key=lambda c: (-fv.SEVERITY_RANK[c[5]], c[0]))
    return F.expr("array(" + ", ".join(
        f"named_struct('order', {-fv.SEVERITY_RANK[severity]}, 'position', {position}, 'conflict_id', '{conflict_id}', "
        f"'role_a', '{a}', 'role_b', '{b}', 'severity', '{severity}', 'compliance', '{compliance}')"
        for position, conflict_id, a, b, _, severity, compliance in ordered
    ) + ")")


def _held() -> Column:
    return F.expr("transform(array_union(roles, permissions), h -> lower(h))")


def sod_matches(pairs: Column | None = None) -> Column:
    """Conflict pairs an identity holds both sides of, worst first; ``pairs`` as from ``sod_array``."""
    return F.filter(
        sod_array() if pairs is None else pairs,
        lambda c: F.array_contains(_held(), F.lower(c["role_a"])) & F.array_contains(_held(), F.lower(c["role_b"])),
    )


def sod_holdings(identities: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(user_id, sod_conflicts) of the identities that hold both sides of a pair in ``conflicts``, worst first.

    For tables of any number of pairs. A pair is filed under the side that fewer identities
    hold, so an item that everybody holds brings nobody to its pairs; whoever holds the rarer
    side is checked for the other. No identity is compared with pairs that it has no side of.
    """
    rank = F.coalesce(F.try_element_at(S.literal_map(fv.SEVERITY_RANK), F.col("severity")), F.lit(1))
    pair = F.struct((-rank).alias("order"), "position", "conflict_id", "role_a", "role_b", "severity", "compliance")
    pairs = conflicts.select(F.lower("role_a").alias("a"), F.lower("role_b").alias("b"), pair.alias("pair"))
    items = identities.select("user_id", F.explode(F.array_distinct(_held())).alias("item"))
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("holders"))
    sides = pairs.join(counts.toDF("a", "of_a"), "a").join(counts.toDF("b", "of_b"), "b")  # a side that nobody holds ends here
    rare = F.col("of_a") <= F.col("of_b")
    index = sides.select(F.when(rare, F.col("a")).otherwise(F.col("b")).alias("item"), F.when(rare, F.col("b")).otherwise(F.col("a")).alias("other"), "pair")
    found = items.join(index, "item").select("user_id", F.col("other").alias("item"), "pair").join(items, ["user_id", "item"], "left_semi")
    return found.groupBy("user_id").agg(F.array_sort(F.collect_set("pair")).alias("sod_conflicts"))


def holds_admin_permission() -> Column:
    return F.expr(HOLDS_ADMIN_PERMISSION)


def standard_rules(t: Thresholds = DEFAULTS) -> list[Rule]:
    """The 13 rules in output order."""
    severity = {r: s for r, s, _ in fv.RULES}
    severity["SOD_VIOLATION"] = "=coalesce(get(sod_conflicts, 0).severity, 'CRITICAL')"
    percent = lambda value, digits: f"concat(format_number({value} * 100, {digits}), '%')"
    peers = "baseline_avg_daily_unique_resources"
    texts = {
        "STALE_PRIVILEGED": (
            f"__idle > {t.stale_days} AND is_privileged",
            "concat('privileged, last login ', __idle, ' days ago')"),
        "ORPHANED_ACCOUNT": (
            "owner_id = '' OR lower(employment_status) = 'terminated'",
            "if(owner_id = '', 'nobody owns the account', 'owner has left, account is live')"),
        "OVER_PRIVILEGED": (
            f"__utilization < {t.utilization_floor}D",
            f"concat('uses ', {percent('__utilization', 1)}, ' of granted permissions')"),
        "SHADOW_ADMIN": (
            f"lower(account_type) <> 'admin' AND {HOLDS_ADMIN_PERMISSION}",
            "'admin permission on an account that is not an admin account'"),
        "PRIVILEGE_CREEP": (
            f"role_changes_90d >= {t.creep_changes}", "concat(role_changes_90d, ' role changes within 90 days')"),
        "SERVICE_ACCT_ABUSE": (
            "lower(account_type) = 'service' AND interactive_login", "'service account that can log in interactively'"),
        "CREDENTIAL_SPRAWL": (
            f"systems_count >= {t.sprawl_systems} AND NOT sso_linked",
            "concat(systems_count, ' systems and no single sign-on')"),
        "IMPOSSIBLE_TRAVEL": ("impossible_travel_detected", "'events flagged as impossible travel'"),
        "CROSS_SYSTEM_TRAVEL": (
            "cross_system_impossible_travel", "'two systems used from distant regions within hours'"),
        "EXCESSIVE_ACCESS": (
            "has_baseline AND unique_resources_accessed > baseline_p95_events_single_session "
            f"AND __anomaly_rate > {t.excessive_anomaly_rate}D",
            "concat(unique_resources_accessed, ' resources in 30 days, above the peer p95')"),
        "LATERAL_MOVEMENT_SPIKE": (
            f"max_resources_in_single_day >= {t.lateral_resources} AND has_baseline AND {peers} > 0 "
            f"AND max_resources_in_single_day >= {peers} * {t.lateral_multiplier}D",
            f"concat(max_resources_in_single_day, ' resources in one day, peers average ', format_number({peers}, 1))"),
        "BULK_DOWNLOAD": (
            f"bulk_download_detected AND off_hours_event_pct > {t.bulk_off_hours_pct}D",
            f"concat('bulk download, off-hours share ', {percent('off_hours_event_pct', 0)})"),
        "SOD_VIOLATION": (
            "size(sod_conflicts) > 0",
            "array_join(transform(sod_conflicts, c -> concat(c.conflict_id, ' ', c.role_a, ' + ', c.role_b, "
            "' (', c.compliance, ')')), '; ')"),
    }
    return [Rule(r, *texts[r], severity[r]) for r in fv.RULE_IDS]


def with_rules(
    identities: DataFrame,
    as_of: Column,
    thresholds: Thresholds = DEFAULTS,
    extra: list[Rule] | None = None,
    conflicts: DataFrame | None = None,
) -> DataFrame:
    """Adds ``rules``: one result per rule, in registry order. No shuffle, unless a table of ``conflicts`` is given."""
    registry = standard_rules(thresholds) + list(extra or [])
    staged = identities.withColumns({
        "__idle": S.days_since_login(as_of),
        "__utilization": S.permission_utilization(),
        "__anomaly_rate": S.ratio(F.col("anomaly_event_count"), F.col("event_count_30d")),
    })
    if conflicts is None:
        staged = staged.withColumn("sod_conflicts", sod_matches())
    else:
        staged = staged.drop("sod_conflicts").join(sod_holdings(identities, conflicts), "user_id", "left")
        staged = staged.withColumn("sod_conflicts", F.coalesce("sod_conflicts", F.filter(sod_array(), lambda c: F.lit(False))))
    results = F.expr("array(" + ", ".join(r.result() for r in registry) + ")")
    return staged.withColumn("rules", results).drop("__idle", "__utilization", "__anomaly_rate")


def triggered(rules: Column) -> Column:
    return F.filter(rules, lambda r: r["triggered"])


def rule_flags() -> dict[str, Column]:
    """rule id to 0/1, counting a rule only when it fired and nothing suppresses it."""
    return {r: F.expr(f"cast(array_contains(contributing_factors, '{r}') as int)") for r in fv.RULE_IDS}


def rules_long(ruled: DataFrame) -> DataFrame:
    """One row per (identity, triggered rule)."""
    return ruled.select("user_id", F.explode(triggered(F.col("rules"))).alias("r")).select("user_id", "r.*")
