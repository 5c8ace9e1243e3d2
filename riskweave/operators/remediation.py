"""Remediation plans, technique mapping and compliance gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave import fixed_values as fv
from riskweave.functions.scalars import sql_literal, sql_map
from riskweave.operators.context import SUPPRESSED_RULE_IDS
from riskweave.sources import dimensions as D

CONTEXT_ACTIONS = {
    "VERIFY_WITH_MANAGER": ("a context signal asks for the manager's word", 5),
    "ENABLE_MFA": ("the account has no second factor", 10),
}


def command_for(action: str) -> str:
    """SQL text: the action's command template, filled with the identity's names."""
    disable = f"coalesce(try_element_at({sql_map(fv.DISABLE_COMMANDS)}, source_system), '{fv.DISABLE_COMMAND_OTHER}')"
    filled = f"if({action} = 'DISABLE_ACCOUNT', {disable}, try_element_at({sql_map(fv.ACTION_COMMANDS)}, {action}))"
    for field in ("username", "email", "source_system"):
        filled = f"replace({filled}, '{{{field}}}', {field})"
    return filled


def plan_array() -> Column:
    """All actions of an identity as one ordered array, built in the row itself.

    Order is by risk reduction, then rule order, follow-up, second factor; the
    severity class is a step function of the reduction and the score is the
    same for all of an identity's actions, so they never change that order.
    """
    action = lambda kind, why, reduction, place: (
        f"named_struct('order', -{reduction}, 'place', {place}, 'action_type', {kind}, "
        f"'description', {why}, 'reduction', {reduction})"
    )
    action_of, reduction_of = sql_map(fv.RULE_ACTION), sql_map(fv.SEVERITY_REDUCTION)
    # a rule muted only by its own ``suppressed_by`` still gets its action
    fired = (
        f"filter(rules, r -> r.triggered AND NOT array_contains({SUPPRESSED_RULE_IDS}, r.rule_id) "
        f"AND map_contains_key({action_of}, r.rule_id))"
    )
    from_rule = action(f"try_element_at({action_of}, r.rule_id)", "r.evidence", f"coalesce(try_element_at({reduction_of}, r.severity), 0)", "i")
    extra = ", ".join(
        f"if({condition}, {action(f"'{kind}'", sql_literal(CONTEXT_ACTIONS[kind][0]), CONTEXT_ACTIONS[kind][1], 1000 + n)}, null)"
        for n, (kind, condition) in enumerate([
            ("VERIFY_WITH_MANAGER", "exists(context_signals, s -> s.requires_followup)"), ("ENABLE_MFA", "NOT mfa_enabled")])
    )
    ordered = f"array_sort(concat(transform({fired}, (r, i) -> {from_rule}), filter(array({extra}), x -> x IS NOT NULL)))"
    approval = ", ".join(f"'{a}'" for a in fv.ACTIONS_NEEDING_APPROVAL)
    return F.expr(f"""transform({ordered}, (a, i) -> named_struct(
      'priority', i + 1, 'action_type', a.action_type, 'target', if(username <> '', username, email),
      'human_readable_description', a.description, 'machine_actionable_command', {command_for('a.action_type')},
      'estimated_risk_reduction', a.reduction,
      'expected_resolution_hours', coalesce(try_element_at({sql_map(fv.ACTION_SLA_HOURS)}, a.action_type), 24),
      'requires_approval', a.action_type IN ({approval})))""")


def with_remediation(scored: DataFrame) -> DataFrame:
    return scored.withColumn("remediation_actions", plan_array())


def remediation_plan(scored: DataFrame) -> DataFrame:
    """One row per (identity, action), priority 1 first."""
    planned = scored if "remediation_actions" in scored.columns else with_remediation(scored)
    return planned.select("user_id", "score", F.explode("remediation_actions").alias("a")).select(
        "user_id", "score", "a.*"
    )


def identity_techniques(scored: DataFrame) -> DataFrame:
    """One row per (identity, contributing rule with a technique), in rule order."""
    spark: SparkSession = scored.sparkSession
    hits = scored.select("user_id", F.posexplode("contributing_factors").alias("place", "rule_id"))
    return (
        hits.join(F.broadcast(D.rule_techniques(spark)), "rule_id")
        .join(F.broadcast(D.techniques(spark)), "technique_id")
        .select("user_id", "place", "technique_id", "name", "tactic", "url", F.col("rule_id").alias("triggered_by_rule"))
    )


def identity_compliance_gaps(scored: DataFrame) -> DataFrame:
    """One row per (identity, contributing rule with a compliance control)."""
    hits = scored.select("user_id", "department", F.explode("contributing_factors").alias("rule_id"))
    return hits.join(F.broadcast(D.compliance_gaps(scored.sparkSession)), "rule_id")
