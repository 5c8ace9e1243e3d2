"""The registered queries: every operator run over the whole benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskweave import fixed_values as fv
from riskweave.functions import parsing as P
from riskweave.models import roles, supervised
from riskweave.models.ensemble import AnomalyEnsemble
from riskweave.models.extra_trees import ExtraTrees
from riskweave.models.lof import k_distances
from riskweave.operators import (
    access, activity, baselines as B, context, evaluation as E, exfiltration, features, graph, remediation, reports,
    rules, sequences, timeline,
)
from riskweave.plans import holdout, scan
from riskweave.plans.lens import as_of, lens_events, lens_users
from riskweave.session import checkpointed
from riskweave.sources import dimensions, providers, sinks, tables
from riskweave.thresholds import Thresholds

Query = Callable[[SparkSession, str], DataFrame]

# The benchmark log is thin per user and day, so the volume cuts are lower here.
CUTS = Thresholds(bulk_download_min=2, bulk_off_hours_pct=0.25, lateral_resources=3, lateral_multiplier=1.5)


def flat(df: DataFrame, drop: tuple = ()) -> DataFrame:
    """Comparable columns: whole numbers as bigint, doubles to 6 digits, arrays as text."""
    columns = []
    for field in df.schema.fields:
        if field.name in drop:
            continue
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.IntegerType, T.LongType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return lens_users(spark, sf_dir), lens_events(spark, sf_dir)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, events = _tables(spark, sf_dir)
    return scan.profiled_identities(users, events, CUTS)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, events = _tables(spark, sf_dir)
    return scan.full_scan(users, events, as_of(), CUTS)


def _over_events(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: flat(run(lens_events(spark, d)))


def _over_users(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: flat(run(lens_users(spark, d)))


def _over_both(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: flat(run(*_tables(spark, d)))


def _over_people(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: flat(run(_people(spark, d)))


def _over_scored(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: flat(run(_scored(spark, d)))


# -- normalisation --------------------------------------------------------------

def _multi_format_timestamps(events: DataFrame) -> DataFrame:
    shape = F.col("event_id").cast("bigint") % 8
    ts = F.col("ts")
    text = (
        F.when(shape == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(shape == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+05:30'"))
        .when(shape == 2, F.date_format(ts, "dd/MM/yyyy"))
        .when(shape == 3, F.date_format(ts, "MM-dd-yyyy"))
        .when(shape == 4, F.unix_seconds(ts).cast("string"))
        .when(shape == 5, F.date_format(ts, "yyyy-MM-dd"))
        .when(shape == 6, F.lit("not a time"))
        .otherwise(F.lit("  "))
    )
    parsed = events.select(shape.alias("shape"), F.unix_seconds(P.parse_timestamp(text)).alias("at"))
    return parsed.groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("at").alias("parsed"),
        F.min("at").alias("first_second"), F.max("at").alias("last_second"),
    )


def _compact_users(users: DataFrame) -> DataFrame:
    c = F.col("user_id").cast("bigint")
    systems = F.array_join(F.slice(F.array("source_system", F.lit("x"), F.lit("y")), 1, (c % 3 + 1).cast("int")), "|")
    raw = users.select(
        F.col("user_id").alias("UID"), F.col("username").alias("User Name"), F.col("email").alias(" Email "),
        F.col("department").alias("dept"), "job_title",
        F.when(c % 4 == 0, "user").when(c % 4 == 1, "admin").when(c % 4 == 2, "power-user")
        .otherwise("service-account").alias("privilege_level"),
        F.when(c % 7 == 0, "").otherwise(systems).alias("systems_access"),
        F.date_format("last_login", "dd/MM/yyyy").alias("last_auth"), F.lit("0").alias("days_inactive"),
        F.when(c % 3 != 0, "True").otherwise("false").alias("is_active"),
        F.date_format("created_at", "MM-dd-yyyy").alias("hire_date"),
    )
    out = tables.normalise_users(raw)
    return out.select(
        "user_id", "is_privileged", "account_type", "employment_status", "systems_count", "source_system",
        F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "owner_id", F.size("roles").alias("n_roles"),
    )


def _compact_events(events: DataFrame) -> DataFrame:
    raw = events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "user_id",
        F.lit("u").alias("username"), "action", "resource", "resource_sensitivity",
        F.when(F.col("success"), "Success").otherwise("failure").alias("status"),
        F.concat(F.lit("10.0.0."), "event_id").alias("source_ip"), "time_classification",
    )
    return tables.normalise_events(raw).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("success").alias("succeeded"),
        F.count_if("off_hours").alias("off_hours"), F.count_distinct("event_id").alias("distinct_ids"),
    )


# -- small projections over shared plans ----------------------------------------

def _raw_titles(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 3
    raw = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.when(k == 0, "Analyst").when(k == 1, "Engineer").otherwise("Manager").alias("job_title"),
    )
    return flat(activity.usual_job_title(raw))


def _zscores(people: DataFrame) -> DataFrame:
    z = F.when(F.col("has_baseline"), B.behavior_zscore(as_of(), CUTS)).otherwise(F.lit(0.0))
    return people.select("user_id", "has_baseline", z.alias("behavior_zscore"), B.peer_deviation().alias("peer_deviation_score"))


def _baseline_by_any_role(users: DataFrame, events: DataFrame) -> DataFrame:
    people = B.attach_baseline(users, B.build_baselines(events, users, CUTS), "role_then_department")
    return people.select("user_id", "has_baseline", "baseline_avg_events_30d")


def _rule_flags(people: DataFrame) -> DataFrame:
    fired = F.transform(rules.triggered(F.col("rules")), lambda r: r["rule_id"])
    out = rules.with_rules(people, as_of(), CUTS).withColumn("fired", fired)
    return out.select("user_id", *[F.array_contains("fired", r).alias(r) for r in fv.RULE_IDS])


def _sod_violations(users: DataFrame) -> DataFrame:
    found = rules.sod_holdings(users, dimensions.sod_conflicts(users.sparkSession))
    return found.select("user_id", F.transform("sod_conflicts", lambda c: c["conflict_id"]).alias("conflict_ids"))


def _discriminators(people: DataFrame) -> DataFrame:
    table = features.feature_table(people, as_of())
    return table.select("user_id", *[c.alias(n) for n, c in features.discriminators().items()])


def _context(scored: DataFrame) -> DataFrame:
    return scored.select(
        "user_id", F.transform("context_signals", lambda s: s["signal_type"]).alias("signals"),
        F.aggregate("context_signals", F.lit(0), lambda t, s: t + s["score_adjustment"]).alias("context_delta"),
        F.col("suppressed_factors").alias("suppressed"),
    )


SCORE_COLUMNS = [
    "user_id", "department", "score", "tier", "contributing_factors", "suppressed_factors", "anomaly_types",
    "primary_rule", "mitre_technique", "suppressed_rule_count", "blast_radius_applied", "behavior_zscore",
    "confidence", "peer_deviation_score",
]


def leaderboard(scored: DataFrame, n: int = 20) -> DataFrame:
    return reports.top_identities(scored, n).select("rank", *SCORE_COLUMNS)


def _seniority(users: DataFrame) -> DataFrame:
    from riskweave.functions.scalars import seniority_exception

    found = users.select("user_id", seniority_exception(F.col("job_title"), F.col("roles")).alias("s"))
    return found.where("s is not null").select("user_id", F.col("s.keyword").alias("keyword"), F.col("s.adjustment").alias("adjustment"))


def _compliance(scored: DataFrame) -> DataFrame:
    return remediation.identity_compliance_gaps(scored).groupBy("department", "framework", "control_id").agg(
        F.count(F.lit(1)).alias("identities"))


def _plan(scored: DataFrame) -> DataFrame:
    return remediation.remediation_plan(scored).select(
        "user_id", "score", "priority", "action_type", "machine_actionable_command", "estimated_risk_reduction",
        "expected_resolution_hours", "requires_approval")


def _requests(users: DataFrame) -> DataFrame:
    c = F.col("user_id").cast("bigint")
    return users.select(
        "user_id", "department", F.concat(F.lit("res_"), (c % 23).cast("string")).alias("resource"),
        F.when(c % 3 == 0, "read").when(c % 3 == 1, "admin").otherwise("download").alias("action"))


def _decisions(users: DataFrame, events: DataFrame) -> DataFrame:
    return access.access_decisions(_requests(users), access.peer_access_rates(events, users)).drop("peer_comparison_note")


# -- graph -----------------------------------------------------------------------

def _graph_users(users: DataFrame) -> DataFrame:
    """The inventory with more and sparser roles, so that reach differs."""
    c = F.col("user_id").cast("bigint")
    role = lambda n: F.concat(F.lit("role_"), (n % 40).cast("string"))
    return users.select(
        "user_id",
        F.when(c % 7 == 6, F.array().cast("array<string>")).otherwise(F.array(role(c), role(c * 3))).alias("roles"),
        F.concat(F.lit("sys_"), (c % 8).cast("string")).alias("source_system"),
        F.array(F.concat(F.lit("perm_"), (c % 16).cast("string"))).alias("permissions"),
    )


def _edge_counts(users: DataFrame) -> DataFrame:
    return graph.graph_edges(graph.dealt(users)).groupBy("type", "target").agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("users"))


# -- providers -------------------------------------------------------------------

def _provider_users(users: DataFrame) -> DataFrame:
    c = F.col("user_id").cast("bigint")
    n = c.cast("string")
    okta = users.where(c % 3 == 0).select(
        F.concat(F.lit("ok"), n).alias("id"),
        F.when(c % 4 == 0, "SUSPENDED").when(c % 4 == 1, "DEPROVISIONED").otherwise("ACTIVE").alias("status"),
        F.lit("2020-01-01").alias("created"), F.date_format("last_login", "yyyy-MM-dd").alias("lastLogin"),
        F.struct(F.col("email").alias("login"), "email", F.lit("A").alias("firstName"), F.lit("B").alias("lastName")).alias("profile"))
    mail = F.when(c % 8 == 0, F.concat(F.lit("guest_"), n, F.lit("@other.org"))).otherwise(F.col("email"))
    azure = users.where(c % 4 == 0).select(
        F.concat(F.lit("az"), n).alias("id"), mail.alias("userPrincipalName"), F.lit(None).cast("string").alias("mail"),
        F.col("username").alias("displayName"), (c % 5 != 0).alias("accountEnabled"))
    aws = users.where(c % 5 == 0).select(
        F.concat(F.lit("aw"), n).alias("UserId"), F.concat(F.lit("user_"), n).alias("UserName"),
        F.when(c % 10 != 0, "2024-01-01T00:00:00Z").alias("PasswordLastUsed"))
    return providers.all_providers(
        providers.normalise_okta(okta), providers.normalise_azure(azure), providers.normalise_aws(aws))


def _unmatched(users: DataFrame) -> DataFrame:
    idp = _provider_users(users)
    inside = providers.internal_only(users, idp).select(F.lit("internal").alias("side"), F.col("user_id").alias("id"))
    return inside.unionByName(providers.provider_only(users, idp).select(F.lit("provider").alias("side"), F.col("external_id").alias("id")))


def _credential_report(users: DataFrame) -> DataFrame:
    c = F.col("user_id").cast("bigint")
    yes = lambda condition: F.when(condition, "true").otherwise("false")
    report = users.select(
        yes(c % 10 < 7).alias("mfa_active"), yes(c % 3 == 0).alias("password_enabled"),
        F.coalesce(F.date_format("last_login", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("no_information")).alias("password_last_used"),
        yes(c % 4 == 1).alias("access_key_1_active"), yes(c % 6 == 1).alias("access_key_2_active"),
        F.when(c % 4 == 1, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("N/A").alias("access_key_1_last_used_date"),
        F.lit("N/A").alias("access_key_2_last_used_date"))
    return providers.credential_metrics(report, as_of())


def _policies(users: DataFrame) -> DataFrame:
    return providers.privileged_by_policy(users.select(
        "user_id", F.col("permissions").alias("attached_policy_names"),
        F.transform("roles", lambda r: F.when(r == "admin", "PowerUserAccess").otherwise(r)).alias("inline_policy_names"),
    )).select("user_id")


def _keys(users: DataFrame) -> DataFrame:
    c = F.col("user_id").cast("bigint")
    status = lambda on: F.when(on, "Active").otherwise("Inactive")
    return users.select(F.col("username").alias("UserName"), F.explode(F.array(status(c % 4 == 1), status(c % 6 == 1))).alias("Status"))


def _feedback(users: DataFrame) -> DataFrame:
    c = F.col("user_id").cast("bigint")
    return sinks.feedback_rows(users.select(
        F.col("user_id").alias("identity_id"), F.lit("REVIEW").alias("original_decision"),
        F.when(c % 4 == 0, "APPROVE").when(c % 4 == 1, "DENY").when(c % 4 == 2, "REVIEW").otherwise("MAYBE").alias("corrected_decision"),
        F.lit("checked").alias("correction_reason")))


# -- evaluation ------------------------------------------------------------------

def _labels(users: DataFrame) -> DataFrame:
    """Labels of the benchmark: every sixth customer is a true positive."""
    return tables.read_labels(users.select(
        "user_id", F.when(F.col("user_id").cast("bigint") % 6 == 2, "True").otherwise("no").alias("is_anomaly")))


def _predictions(scored: DataFrame) -> DataFrame:
    return scored.select("user_id", "department", (F.col("score") >= 60).alias("is_anomaly"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return E.join_labels(_predictions(_scored(spark, d)), _labels(lens_users(spark, d)))


def _over_judged(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: flat(run(_judged(spark, d)))


def _event_confusion(spark: SparkSession, d: str) -> DataFrame:
    labelled = lens_events(spark, d).select("event_id", "user_id", "is_anomaly")
    return flat(E.event_confusion(labelled, _predictions(_scored(spark, d))))


def _event_class_metrics(events: DataFrame) -> DataFrame:
    e = F.col("event_id").cast("bigint")
    truth = events.select("event_id", "is_anomaly", "anomaly_type")
    guessed = F.when(e % 7 == 0, "reconnaissance").when(e % 11 == 0, "").otherwise(F.col("anomaly_type"))
    predicted = events.select("event_id", "is_anomaly", guessed.alias("anomaly_type"))
    return E.class_metrics(E.confusion_matrix(E.join_labels(predicted, truth)))


# -- models ----------------------------------------------------------------------

def _labelled_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of every identity with its label, materialised once for the fitting passes."""
    table = features.feature_table(_people(spark, d), as_of(), keep=["department", "job_title"])
    return checkpointed(E.align_labels(table, _labels(lens_users(spark, d))))


def _risk_labels(scored: DataFrame) -> DataFrame:
    """Labels that features can tell: the identities with the highest scores, under a fifth of them."""
    return tables.read_labels(scored.select("user_id", F.when(F.col("score") >= 95, "True").otherwise("no").alias("is_anomaly")))


def _risk_features(spark: SparkSession, d: str) -> DataFrame:
    table = features.feature_table(_people(spark, d), as_of(), keep=["department", "job_title"])
    return checkpointed(E.align_labels(table, _risk_labels(_scored(spark, d))))


def _anomaly_ensemble(spark: SparkSession, d: str) -> DataFrame:
    table = _labelled_features(spark, d)
    return flat(AnomalyEnsemble.fit(table, fv.FEATURE_NAMES).predict(table))


def _lof_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 20-distance of every customer over its balance, spending and number of orders."""
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("spent"))
    raw = spark.read.parquet(f"{d}/customer.parquet").join(orders, "c_custkey", "left")
    # the sum is rounded to cents: it must not depend on the order of its terms
    spent = F.round(F.coalesce("spent", F.lit(0.0)), 2) / 100_000
    numbers = F.col("c_acctbal").cast("double") / 1000, spent, F.coalesce("n", F.lit(0)).cast("double")
    pts = raw.select(F.col("c_custkey").cast("string").alias("id"), F.array(*numbers).alias("x"))
    return flat(k_distances(pts).withColumnRenamed("id", "user_id"))


def _risk_classifier(spark: SparkSession, d: str) -> DataFrame:
    table = _risk_features(spark, d)
    model = supervised.RiskClassifier.fit(table, fv.FEATURE_NAMES)
    return flat(model.predict(table).select("user_id", "label", "risk_probability"))


def _extra_trees(spark: SparkSession, d: str) -> DataFrame:
    table = _risk_features(spark, d)
    split = checkpointed(supervised.stratified_holdout(table))
    model = ExtraTrees.fit(split.where(~F.col("is_test")), fv.FEATURE_NAMES)
    return flat(model.predict(split.where("is_test")).select("user_id", "label", "extra_probability"))


def _smote_balance(spark: SparkSession, d: str) -> DataFrame:
    balanced = supervised.smote(_labelled_features(spark, d), fv.FEATURE_NAMES)
    return flat(balanced.groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def _stratified_split(spark: SparkSession, d: str) -> DataFrame:
    labelled = E.align_labels(lens_users(spark, d), _labels(lens_users(spark, d)))
    split = supervised.stratified_holdout(labelled)
    return flat(split.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n")))


def _access_predictor(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on every grant seen in the log with its peer-rate decision, applied to all requests."""
    users, events = _tables(spark, d)
    rates = access.peer_access_rates(events, users)
    titles = users.select("department", "job_title").distinct()
    seen = rates.join(titles, "department").withColumns(access.decision_columns(F.col("peer_access_rate")))
    decided = checkpointed(seen.select(*supervised.ACCESS_FEATURES, "peer_access_rate", "decision"))
    requests = _requests(users).join(users.select("user_id", "job_title"), "user_id")
    rated = access.access_decisions(requests, rates)
    return flat(supervised.predict_access(supervised.fit_access_predictor(decided), rated).select(
        "user_id", "decision", "predicted_decision", "predicted_confidence"))


def _access_vectors(users: DataFrame, events: DataFrame) -> DataFrame:
    """The sparse rows of role mining, read back entry by entry by the vocabulary's places."""
    matrix = roles.access_matrix(events, users)
    places = roles.vocabulary(matrix)
    entries = roles.access_vectors(matrix, places).select("user_id", F.explode(F.arrays_zip("at", "value")).alias("e"))
    return entries.select("user_id", F.col("e.at").alias("i"), F.col("e.value").alias("share")).join(places, "i")


def _mined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    users, events = _tables(spark, d)
    matrix = checkpointed(roles.access_matrix(events, users))
    model, scaled = roles.fit_roles(matrix)
    return roles.assign_roles(model, scaled), matrix, events


def _role_assignments(spark: SparkSession, d: str) -> DataFrame:
    return flat(_mined(spark, d)[0])


def _role_profiles(spark: SparkSession, d: str) -> DataFrame:
    assigned, matrix, events = _mined(spark, d)
    return flat(roles.profile_roles(assigned, matrix, roles.grant_counts(events), _scored(spark, d)))


def _holdout_report(spark: SparkSession, d: str) -> DataFrame:
    users, events = _tables(spark, d)
    result = holdout.run_holdout(users, events, _risk_labels(_scored(spark, d)), as_of(), CUTS)
    return flat(result.report)


def registered_queries() -> dict[str, Query]:
    return {
        "multi_format_timestamps": _over_events(_multi_format_timestamps),
        "compact_users": _over_users(_compact_users),
        "compact_events": _over_events(_compact_events),
        "event_features_30_90": _over_events(lambda e: activity.windowed_features(e, CUTS).drop(
            "max_resources_in_single_day", "max_resources_in_single_session")),
        "cross_system_travel": _over_events(timeline.cross_system_travel),
        "daily_resource_peaks": _over_events(lambda e: activity.windowed_features(e, CUTS).select(
            "user_id", "max_resources_in_single_day", "max_resources_in_single_session")),
        "usual_job_title": _raw_titles,
        "anomaly_mix": _over_events(lambda e: activity.anomaly_mix(e, activity.anomaly_types(e))),
        "baseline_profiles": _over_both(lambda u, e: B.build_baselines(e, u, CUTS).select(*B.KEY, *B.PROFILE_NUMBERS)),
        "finance_multipliers": _over_both(lambda u, e: B.finance_multipliers(B.baseline_cells(e, u, CUTS), CUTS)),
        "typical_hours_topk": _over_both(lambda u, e: B.typical_hours(B.baseline_cells(e, u, CUTS))),
        "typical_resources_topk": _over_both(lambda u, e: B.typical_resources(B.baseline_cells(e, u, CUTS))),
        "peer_stats": _over_both(lambda u, e: B.peer_stats(activity.identities(u, activity.user_activity(e, CUTS)))),
        "behavior_zscore": _over_people(_zscores),
        "baseline_by_any_role": _over_both(_baseline_by_any_role),
        "monthly_band": _over_both(lambda u, e: B.monthly_band(e, u)),
        "feature_vector": _over_people(lambda p: features.feature_table(p, as_of())),
        "discriminators": _over_people(_discriminators),
        "rule_flags": _over_people(_rule_flags),
        "sod_violations": _over_users(_sod_violations),
        "context_signals": _over_scored(_context),
        "seniority_exceptions": _over_users(_seniority),
        "risk_scores": _over_scored(lambda s: s.select(*SCORE_COLUMNS)),
        "scan_leaderboard": _over_scored(leaderboard),
        "remediation_plan": _over_scored(_plan),
        "remediation_sample": _over_scored(lambda s: reports.remediation_sample(s).drop("description")),
        "identity_techniques": _over_scored(lambda s: remediation.identity_techniques(s).drop("place", "url")),
        "compliance_gaps": _over_scored(_compliance),
        "attack_chains": _over_events(sequences.attack_chains),
        "attack_chains_72h": _over_events(lambda e: sequences.attack_chains(e, window_hours=72)),
        "exfiltration_alerts": _over_both(lambda u, e: exfiltration.exfiltration_alerts(e, u).drop("description")),
        "peer_access_rate": _over_both(lambda u, e: access.peer_access_rates(e, u)),
        "access_decisions": _over_both(_decisions),
        "tier_distribution": _over_scored(reports.tier_distribution),
        "department_risk": _over_scored(lambda s: reports.department_risk(s)),
        "organization_risk": _over_scored(lambda s: reports.organization_risk(s)),
        "primary_rule_top8": _over_scored(reports.primary_rule_counts),
        "anomaly_type_counts": _over_scored(reports.anomaly_type_counts),
        "technique_counts": _over_scored(reports.technique_counts),
        "technique_table": _over_scored(reports.technique_table),
        "executive_summary": _over_scored(reports.executive_summary),
        "leaderboard_page": _over_scored(lambda s: reports.leaderboard_page(
            reports.leaderboard_filter(s, department="finance"), page=2, page_size=25).select("rank", "user_id", "score", "tier")),
        "leaderboard_page_count": _over_scored(lambda s: reports.page_count(reports.leaderboard_filter(s, department="FINANCE"))),
        "leaderboard_rank_all": _over_scored(lambda s: reports.rank_all(s.select("user_id", "score")).select("rank", "user_id", "score")),
        "leaderboard_export": _over_scored(lambda s: reports.leaderboard_export(
            s, tiers=["critical", "HIGH"], anomaly_type="impossible_travel", search="USER_1")),
        "filter_values": _over_scored(reports.filter_values),
        "identity_lookup": _over_scored(lambda s: reports.identity_by_id(s, "42").select("user_id", "username", "department", "score", "tier")),
        "risk_scatter": _over_scored(lambda s: reports.risk_scatter(s, as_of()).drop("username", "cluster")),
        "graph_edges": _over_users(_edge_counts),
        "graph_nodes": _over_scored(graph.graph_nodes),
        "blast_radius": _over_users(lambda u: graph.blast_radius(_graph_users(u)).drop("narrative")),
        "downstream_users": _over_users(lambda u: graph.downstream_users(_graph_users(u), "5")),
        "provider_summary": _over_users(lambda u: providers.provider_summary(_provider_users(u))),
        "provider_match": _over_users(lambda u: providers.match_identities(u, _provider_users(u)).drop("email")),
        "provider_unmatched": _over_users(_unmatched),
        "provider_matched_count": _over_users(lambda u: providers.matched_count(u, _provider_users(u))),
        "credential_metrics": _over_users(_credential_report),
        "privileged_by_policy": _over_users(_policies),
        "access_keys": _over_users(lambda u: providers.access_keys_by_user(_keys(u))),
        "access_key_summary": _over_users(lambda u: providers.access_key_summary(_keys(u))),
        "feedback_summary": _over_users(lambda u: reports.feedback_summary(_feedback(u))),
        "user_metrics": _over_judged(E.summary_metrics),
        "user_confusion": _over_judged(E.confusion_matrix),
        "fpr_by_department": _over_judged(E.fpr_by_department),
        "metric_gate": _over_judged(lambda j: E.metric_gate(E.summary_metrics(j)).drop("overall_f1", "false_positive_rate")),
        "evaluation_status": _over_users(lambda u: E.evaluation_status(E.align_labels(u, _labels(u)))),
        "event_confusion": _event_confusion,
        "event_class_metrics": _over_events(_event_class_metrics),
        "access_matrix": _over_both(lambda u, e: roles.access_matrix(e, u)),
        "access_vectors": _over_both(_access_vectors),
        "stratified_split": _stratified_split,
        "smote_balance": _smote_balance,
        "lof_neighbours": _lof_neighbours,
        "anomaly_ensemble": _anomaly_ensemble,
        "risk_classifier": _risk_classifier,
        "extra_trees": _extra_trees,
        "access_predictor": _access_predictor,
        "role_assignments": _role_assignments,
        "role_profiles": _role_profiles,
        "holdout_report": _holdout_report,
    }
