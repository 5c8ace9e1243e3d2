from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.functions.numbering import numbered
from riskweave.functions.salting import salted_left_join
from riskweave.operators import access, evaluation as E, exfiltration, graph, reports
from riskweave.sources import providers, sinks


def scored(spark, rows):
    full = [(u, s, t, d, [p] if p else [], p or "", u, f"{u}@x", "AD", "", 0, False) for u, s, t, d, p in rows]
    return spark.createDataFrame(full, """user_id string, score int, tier string, department string, anomaly_types array<string>, primary_rule string,
        username string, email string, source_system string, mitre_technique string, suppressed_rule_count int, blast_radius_applied boolean""")


def test_rank_all_is_the_full_order_even_when_one_score_dominates(spark):
    rng = random.Random(3)
    rows = [(f"u{i:04d}", 50 if rng.random() < 0.6 else rng.randrange(101), "LOW", "IT", None) for i in range(600)]
    got = reports.rank_all(scored(spark, rows).repartition(7), partitions=5).select("rank", "user_id").collect()
    want = [u for u, s, *_ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [u for _, u in sorted((r["rank"], r.user_id) for r in got)] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 601))


def test_filters_pages_and_rollups(spark, tmp_path):
    df = scored(spark, [("a", 90, "CRITICAL", "HR", "R1"), ("b", 90, "CRITICAL", "IT", "R2"), ("c", 10, "LOW", "HR", None), ("d", 65, "HIGH", "HR", "R1")])
    ids = lambda out: [r.user_id for r in out.orderBy("user_id").collect()]
    assert ids(reports.leaderboard_filter(df, tiers=["critical", "high"], department="hr")) == ["a", "d"]
    assert ids(reports.leaderboard_filter(df, anomaly_type="r2")) == ["b"] and ids(reports.leaderboard_filter(df, search="C@X")) == ["c"]
    page = reports.leaderboard_page(df, page=2, page_size=3).collect()
    assert [(r["rank"], r.user_id) for r in page] == [(4, "c")]
    assert reports.page_count(df.limit(0)).first().pages == 1
    tiers = {r.tier: (r.identities, r.percentage) for r in reports.tier_distribution(df).collect()}
    assert tiers == {"CRITICAL": (2, 50.0), "HIGH": (1, 25.0), "MEDIUM": (0, 0.0), "LOW": (1, 25.0)}
    hr = {r.department: r for r in reports.department_risk(df).collect()}["HR"]
    assert (hr.user_count, hr.critical_count, hr.high_count, hr.avg_score, hr.risk_percentage) == (3, 1, 1, 55.0, 100.0)
    assert [(r.primary_rule, r.identities) for r in reports.primary_rule_counts(df).collect()] == [("R1", 2), ("R2", 1)]
    sinks.write_csv(reports.leaderboard_export(df, department="HR"), str(tmp_path / "board"))
    back = spark.read.option("header", True).csv(str(tmp_path / "board"))
    assert back.columns == sinks.LEADERBOARD_COLUMNS and back.count() == 3


def test_feedback_and_baseline_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "REVIEW", "DENY", "x"), ("2", "REVIEW", "maybe", "x")],
                                 "identity_id string, original_decision string, corrected_decision string, correction_reason string")
    sinks.append_feedback(rows, str(tmp_path / "f"))
    sinks.append_feedback(rows, str(tmp_path / "f"))
    summary = reports.feedback_summary(spark.read.parquet(str(tmp_path / "f"))).first()
    assert (summary.total_corrections, summary.pending_corrections) == (2, 2)
    profiles = spark.createDataFrame([("IT", "Eng", 1.0, ["r"]), ("007", "Eng", 2.0, [])], "department string, job_title string, avg_events_30d double, typical_resources array<string>")
    sinks.write_baselines(profiles, str(tmp_path / "b"))
    assert {(r.department, r.avg_events_30d) for r in sinks.read_baselines(spark, str(tmp_path / "b")).collect()} == {("IT", 1.0), ("007", 2.0)}


def test_salted_join_is_the_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    plain = sorted(map(tuple, left.join(right, "k", "left").collect()), key=repr)
    salted = salted_left_join(left, right, ["k"], F.col("i"), 8)
    assert sorted(map(tuple, salted.select("k", "i", "v").collect()), key=repr) == plain


def test_peer_access_and_decisions(spark):
    rows = [(f"u{i}", "IT", "db", "read") for i in range(9)] + [("u9", "IT", "db", "write"), ("u1", "IT", "db", "read"), ("x", "HR", "db", "read")]
    events = spark.createDataFrame(rows, "user_id string, department string, resource string, action string")
    rates = access.peer_access_rates(events)
    requests = spark.createDataFrame([("IT", "db", "read"), ("IT", "db", "write"), ("HR", "db", "read"), ("HR", "vault", "read")], "department string, resource string, action string")
    got = {(r.department, r.resource, r.action): (r.decision, r.confidence, round(r.peer_access_rate, 3)) for r in access.access_decisions(requests, rates).collect()}
    assert got == {("IT", "db", "read"): ("APPROVE", 0.95, 0.9), ("IT", "db", "write"): ("DENY", 0.80, 0.1),
                   ("HR", "db", "read"): ("APPROVE", 0.95, 1.0), ("HR", "vault", "read"): ("DENY", 0.90, 0.0)}


def test_exfiltration_levels(spark):
    def log(user, n, late=0, sensitive=0, level="high"):
        return [(user, "Export" if i % 2 else "download", level if i < sensitive else "low", "night" if i < late else "business_hours", datetime(2024, 1, 1, 12)) for i in range(n)]
    rows = log("few", 4) + log("low", 5) + log("medium", 10) + log("high", 8, late=3, sensitive=2) + log("critical", 8, late=3, sensitive=4, level="critical")
    events = spark.createDataFrame(rows, "user_id string, action string, resource_sensitivity string, time_classification string, ts timestamp")
    users = spark.createDataFrame([(u, u) for u in ("few", "low", "medium", "high", "critical")], "user_id string, username string")
    got = {r.user_id: (r.risk_level, r.exfiltration_score) for r in exfiltration.exfiltration_alerts(events, users).collect()}
    assert got == {"low": ("LOW", 5), "medium": ("MEDIUM", 10), "high": ("HIGH", 20), "critical": ("CRITICAL", 30)}


def test_blast_radius_and_graph(spark):
    users = spark.createDataFrame([
        ("a", "a", ["r1"], "s1", ["p1"], "human", False, "LOW", 1), ("b", "b", ["r1", "r2"], "s2", ["p2", "admin:x"], "human", False, "LOW", 2),
        ("c", "c", ["r3"], "s3", [], "human", False, "LOW", 3), ("d", "d", [], "s1", ["p9"], "admin", False, "LOW", 4)],
        "user_id string, username string, roles array<string>, source_system string, permissions array<string>, account_type string, is_privileged boolean, tier string, score int")
    got = {r.identity_id: (r.systems_at_risk, r.sensitive_resources, r.downstream_user_count, r.estimated_impact_score) for r in graph.blast_radius(users).collect()}
    both = (["s1", "s2"], ["admin:x", "p1", "p2"], 1, 55)
    assert got == {"a": both, "b": both, "c": (["s3"], [], 0, 5), "d": ([], [], 0, 0)}
    assert [r.user_id for r in graph.downstream_users(users, "a").collect()] == ["b"] and graph.downstream_users(users, "d").count() == 0
    assert graph.graph_edges(users).count() == 4 + 4 + 4
    assert {r.id: r.shadow_admin for r in graph.graph_nodes(users).where("type = 'user'").collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_downstream_counts_equal_all_pairs_of_users(spark):
    rng = random.Random(8)
    rows = [(f"u{k}", [f"r{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))], f"s{min(rng.randrange(30), rng.randrange(30))}", [f"p{rng.randrange(9)}"]) for k in range(900)]
    users = spark.createDataFrame(rows, "user_id string, roles array<string>, source_system string, permissions array<string>")
    held = {}
    for _, roles, system, _ in rows:
        for role in roles:
            held.setdefault(role, set()).add(system)
    reach = {u: set().union(*(held[r] for r in roles)) for u, roles, *_ in rows}
    want = {u: max(0, sum(bool(own & other) for other in reach.values()) - 1) for u, own in reach.items()}
    assert {r.identity_id: r.downstream_user_count for r in graph.blast_radius(users).collect()} == want
    assert {r.user_id for r in graph.downstream_users(users, "u1").collect()} == {u for u in reach if u != "u1" and reach[u] & reach["u1"]}


def test_numbers_are_dense_over_uneven_partitions(spark):
    rows = spark.range(1000).where("id % 7 < 3 OR id > 900").repartition(5)
    got = numbered(rows).toPandas()
    assert sorted(got["number"]) == list(range(len(got))) and len(set(got["id"])) == len(got)
    assert numbered(rows.where("false")).count() == 0


def test_provider_normalisers_and_matching(spark):
    okta = spark.createDataFrame([("o1", "DEPROVISIONED", "2020", None, ("jo@x", None, "Jo", None))],
        "id string, status string, created string, lastLogin string, profile struct<login string, email string, firstName string, lastName string>")
    azure = spark.createDataFrame([("z1", "JO@x", None, "Jo", None, "Eng", "IT"), ("z2", "plain", "m@x", "M", False, None, None)],
        "id string, userPrincipalName string, mail string, displayName string, accountEnabled boolean, jobTitle string, department string")
    aws = spark.createDataFrame([(None, "arn:1", "bot", None)], "UserId string, Arn string, UserName string, PasswordLastUsed string")
    idp = providers.all_providers(providers.normalise_okta(okta), providers.normalise_azure(azure), providers.normalise_aws(aws))
    got = {r.external_id: (r.username, r.email, r.display_name, r.status) for r in idp.collect()}
    assert got == {"o1": ("jo", "jo@x", "Jo", "inactive"), "z1": ("JO", "JO@x", "Jo", "active"), "z2": ("plain", "m@x", "M", "inactive"),
                   "arn:1": ("bot", "bot@company.com", "bot", "inactive")}
    users = spark.createDataFrame([("1", "Jo@X"), ("2", "bot@company.com"), ("3", "new@x"), ("4", "")], "user_id string, email string")
    matched = {r.user_id: r.provider for r in providers.match_identities(users, idp).collect()}
    assert matched == {"1": "okta", "2": "aws_iam", "3": None, "4": None}
    assert providers.matched_count(users, idp).first().matched_emails == 2
    assert [r.external_id for r in providers.provider_only(users, idp).collect()] == ["z2"]


def test_credential_metrics(spark):
    report = spark.createDataFrame([("false", "true", "2024-01-01T00:00:00+00:00", "true", "N/A", "true", "2024-06-01T00:00:00Z"),
                                    ("TRUE", "false", "no_information", "true", "2023-01-01", "false", "not_supported"), (None, None, "bad", None, None, None, "")],
        "mfa_active string, password_enabled string, password_last_used string, access_key_1_active string, access_key_1_last_used_date string, access_key_2_active string, access_key_2_last_used_date string")
    m = providers.credential_metrics(report, F.lit("2024-06-13 15:00:00").cast("timestamp")).first().asDict()
    assert list(m.values()) == [3, 1, 1, 3, 2, 1, 1, 1, 0]


def judged(spark, rows):
    p = spark.createDataFrame([(u, p, d) for u, p, _, d in rows], "user_id string, is_anomaly int, department string")
    t = spark.createDataFrame([(u, t) for u, _, t, _ in rows], "user_id string, is_anomaly int")
    return E.join_labels(p, t)


def test_false_positive_rates_by_department(spark):
    j = judged(spark, [("1", 1, 0, "HR"), ("2", 0, 0, "HR"), ("3", 1, 0, "IT"), ("4", 0, 0, "IT"), ("5", 1, 1, "IT"), ("6", 1, 1, "Ops")])
    assert {r.department: r.false_positive_rate for r in E.fpr_by_department(j).collect()} == {"HR": 0.5, "IT": 0.5, "Ops": 0.0}
    s = E.summary_metrics(j).first()
    assert (s.rows, s.overall_f1, s.false_positive_rate) == (6, pytest.approx(2 / 3), 0.5)
    assert s.macro_f1 == pytest.approx(2 / 3) and s.weighted_f1 == pytest.approx(2 / 3)
    gate = E.metric_gate(E.summary_metrics(j)).first()
    assert not gate.f1_met and not gate.fpr_met
    empty = E.summary_metrics(j.limit(0)).first()
    assert (empty.rows, empty.overall_f1, empty.macro_f1, empty.weighted_f1, empty.false_positive_rate) == (0, 0.0, 0.0, 0.0, 0.0)


def test_event_confusion_counts_by_user_and_moves_no_event_row(spark):
    rows = [(f"e{k}", f"u{k % 7}" if k % 11 else None, k % 3 == 0) for k in range(500)]
    labels = spark.createDataFrame(rows, "event_id string, user_id string, is_anomaly boolean")
    users = spark.createDataFrame([("u1", 1), ("u2", 0), ("u2", 1), ("u3", 0)], "user_id string, is_anomaly int")
    found = E.event_confusion(labels, users)
    want = {}
    for _, user, true in rows:
        cell = str(int(true)), "1" if user in ("u1", "u2") else "0"
        want[cell] = want.get(cell, 0) + 1
    assert {(r["true"], r.pred): r.n for r in found.collect()} == want
    by_event = E.confusion_matrix(E.join_labels(E.event_predictions(labels, labels, users), labels))
    assert {(r["true"], r.pred): r.n for r in by_event.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "event_id" not in plan.split("Exchange")[0] and not any("event_id" in line for line in plan.splitlines() if "Exchange" in line)


def test_event_predictions_and_status(spark):
    labels = spark.createDataFrame([("e1", 1), ("e2", 0), ("gone", 1)], "event_id string, is_anomaly int")
    events = spark.createDataFrame([("e1", "u1"), ("e2", "u2")], "event_id string, user_id string")
    users = spark.createDataFrame([("u1", 1)], "user_id string, is_anomaly int")
    assert {r.event_id: r.is_anomaly for r in E.event_predictions(labels, events, users).collect()} == {"e1": 1, "e2": 0, "gone": 0}
    people = spark.createDataFrame([(f"u{i}",) for i in range(12)], "user_id string")
    status = lambda l, p=people: E.evaluation_status(E.align_labels(p, l)).first().status
    assert status(users) == "ok" and status(users.limit(0)) == "label_mismatch" and status(users, people.limit(5)) == "empty"


def test_edges_of_many_users_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "DEALT_USERS", 10)
    users = spark.range(95).selectExpr("cast(id % 90 as string) as user_id", "array('viewer') as roles", "'AD' as source_system", "array('read:all') as permissions").coalesce(1)
    dealt = graph.dealt(users)
    assert dealt.rdd.getNumPartitions() == 10
    homes = dealt.select("user_id", F.spark_partition_id().alias("task")).groupBy("user_id").agg(F.count_distinct("task").alias("n"))
    assert homes.count() == 90 and homes.where("n > 1").isEmpty()
    assert graph.graph_edges(dealt).exceptAll(graph.graph_edges(users)).isEmpty() and dealt.count() == 95
    assert graph.dealt(users.limit(0)).count() == 0
