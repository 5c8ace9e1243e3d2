from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave import fixed_values as fv
from riskweave.functions.quantiles import group_quantile
from riskweave.operators import activity, baselines as B, sequences, timeline
from riskweave.thresholds import Thresholds

SCHEMA = """event_id string, user_id string, ts timestamp, resource string, action string, location string, source_system string,
anomaly_type string, success boolean, is_anomaly boolean, department string, job_title string"""
END = datetime(2024, 6, 30, 12)


def event(i, user="u", ts=END, resource="r", action="read", location="", source="", kind="", ok=True, bad=False, dept="IT", title="Engineer"):
    return (str(i).zfill(6), user, ts, resource, action, location, source, kind, ok, bad, dept, title)


def random_events(seed, users, n, minutes):
    """A log in which the first user owns a third of all rows; times collide on purpose."""
    rng = random.Random(seed)
    kinds = sequences.CHAIN_TYPES + ["", "", "other"]
    rows = []
    for i in range(n):
        user = "u0" if rng.random() < 1 / 3 else f"u{rng.randrange(users)}"
        ts = None if rng.random() < 0.02 else END - timedelta(minutes=rng.randrange(minutes))
        rows.append(event(i, user, ts, f"r{rng.randrange(6)}", rng.choice(["read", "download"]), rng.choice([*fv.REGION_BY_LOCATION, "Mars"]),
                          rng.choice(["AD", "Okta", "AWS_IAM"]), rng.choice(kinds), rng.random() < 0.8, rng.random() < 0.3))
    return rows


def brute_travel(rows):
    by_user = defaultdict(list)
    for r in rows:
        if r[2] is not None:
            by_user[r[1]].append(r)
    out = {}
    for user, events in by_user.items():
        events.sort(key=lambda r: (r[2], r[0]))
        region = lambda r: fv.REGION_BY_LOCATION.get(r[5])
        out[user] = any(b[2] - a[2] <= timedelta(hours=3) and a[6] != b[6] and region(a) and region(b) and region(a) != region(b)
                        for a, b in zip(events, events[1:]))
    return out


@pytest.mark.parametrize("width", [60, 3600, 86400])
def test_cross_system_travel_matches_brute_force_for_any_slice(spark, width):
    rows = random_events(width, 60, 600, 60 * 24 * 20)
    got = timeline.cross_system_travel(spark.createDataFrame(rows, SCHEMA).repartition(5), slice_seconds=width)
    assert {r.user_id: r.cross_system_impossible_travel for r in got.collect()} == brute_travel(rows)
    assert len(set(brute_travel(rows).values())) == 2


def brute_chains(rows, window, min_types, count_blank):
    by_user = defaultdict(list)
    for r in rows:
        if r[2] is not None:
            by_user[r[1]].append((r[2], r[7]))
    out = {}
    for user, events in by_user.items():
        best = (0.0, None)
        for start in sorted({t for t, _ in events}):
            kinds = {k for t, k in events if start <= t <= start + window and (count_blank or k)}
            n = len(kinds)
            if {"reconnaissance", "privilege_escalation", "lateral_movement", "bulk_download"} <= kinds:
                pattern = "recon_to_exfil"
            elif "lateral_movement" in kinds and n >= 2:
                pattern = "lateral_movement"
            elif {"privilege_escalation", "reconnaissance"} <= kinds:
                pattern = "privilege_escalation_chain"
            elif "impossible_travel" in kinds and n >= 2:
                pattern = "impossible_travel_sequence"
            elif {"brute_force", "successful_login"} <= kinds:
                pattern = "brute_force_then_success"
            else:
                pattern = None
            confidence = min(0.95, 0.5 + n * 0.1)
            if n >= min_types and pattern and confidence > best[0]:
                best = (confidence, pattern)
        out[user] = (best[1] is not None, best[1], round(best[0], 9))
    return out


@pytest.mark.parametrize("hours,count_blank", [(2.0, True), (2.0, False), (0.5, True), (7.25, True)])
def test_attack_chains_match_brute_force(spark, hours, count_blank):
    rows = random_events(int(hours * 10), 25, 700, 60 * 24 * 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sequences.attack_chains(df, hours, 3, count_blank).collect()
    want = brute_chains(rows, timedelta(hours=hours), 3, count_blank)
    assert {r.user_id: (r.pattern_detected, r.pattern_type, round(r.sequence_confidence, 9)) for r in got} == want
    assert len({v[1] for v in want.values()}) > 2


def test_few_slices_of_a_plain_log_are_looked_at(spark):
    """Ten users of many plain events, one of whom has a chain: the bound leaves its slices, and the result is exact."""
    rows = [event(i, user=f"u{i % 10}", ts=END + timedelta(minutes=3 * i), kind="" if i % 3 else "bulk_download") for i in range(3_000)]
    chain = ["reconnaissance", "privilege_escalation", "lateral_movement", "bulk_download"]
    rows += [event(5_000 + k, user="u4", ts=END + timedelta(hours=70, minutes=20 * k), kind=kind) for k, kind in enumerate(chain)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, cells = sequences.time_cells(df, 300)
    possible = sequences.possible_slices(cells, 24, 3, True).toPandas()
    assert set(possible["user_id"]) == {"u4"} and len(possible) < 0.05 * cells.select("user_id", "slice").distinct().count()
    got = {r.user_id: (r.pattern_detected, r.pattern_type, round(r.sequence_confidence, 9)) for r in sequences.attack_chains(df).collect()}
    assert got == brute_chains(rows, timedelta(hours=2), 3, True) and got["u4"] == (True, "recon_to_exfil", 0.95) and len(got) == 10


def test_chains_of_a_null_user_and_of_types_without_a_pattern(spark):
    rows = [event(k, user=None, ts=END + timedelta(minutes=k), kind=kind) for k, kind in enumerate(["lateral_movement", "x", "y"])]
    rows += [event(10 + k, user="v", ts=END + timedelta(minutes=k), kind=kind) for k, kind in enumerate(["x", "y", "z", "w"])]
    got = {r.user_id: (r.pattern_detected, r.pattern_type) for r in sequences.attack_chains(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: (True, "lateral_movement"), "v": (False, None)}


def test_chain_of_five_types_in_one_row(spark):
    kinds = ["reconnaissance", "privilege_escalation", "lateral_movement", "bulk_download", "impossible_travel"]
    rows = [event(i, ts=END + timedelta(minutes=15 * i), kind=kinds[i % 5]) for i in range(10)]
    out = sequences.attack_chains(spark.createDataFrame(rows, SCHEMA), min_types=2).collect()
    assert [(r.pattern_detected, r.pattern_type, r.sequence_confidence) for r in out] == [(True, "recon_to_exfil", 0.95)]


def test_windowed_features_by_hand(spark):
    rows = [
        event(1, ts=END, resource="a"), event(2, ts=END - timedelta(days=30), resource="b", ok=False, bad=True),
        event(3, ts=END - timedelta(days=30, seconds=1), resource="c", action="Download"),
        event(4, ts=END - timedelta(days=90), resource="a", kind="Impossible_Travel", ok=None),
        event(5, ts=END - timedelta(days=200), resource="d"), event(6, ts=END - timedelta(days=200), resource="e"),
        event(7, ts=datetime(2024, 6, 29, 5, 59), resource=None, action="download"), event(8, "idle", ts=None),
    ]
    got = {r.user_id: r for r in activity.windowed_features(spark.createDataFrame(rows, SCHEMA), Thresholds(bulk_download_min=1)).collect()}
    u = got["u"]
    assert (u.event_count_30d, u.event_count_90d, u.unique_resources_accessed) == (3, 5, 2)
    assert (u.failed_attempt_count, u.anomaly_event_count, u.impossible_travel_detected) == (2, 1, True)
    assert u.bulk_download_detected and u.off_hours_event_pct == 0.2
    assert (u.max_resources_in_single_day, u.max_resources_in_single_session) == (2, 2)
    assert abs(u.avg_time_between_events_hours - 90 * 24 / 4) < 1e-9
    idle = got["idle"]
    assert (idle.event_count_90d, idle.max_resources_in_single_day, idle.avg_time_between_events_hours) == (0, 0, 0.0)


def test_partitioning_does_not_change_features(spark):
    df = spark.createDataFrame(random_events(7, 20, 500, 60 * 24 * 120), SCHEMA)
    one = sorted(map(str, activity.user_activity(df.coalesce(1)).collect()))
    many = sorted(map(str, activity.user_activity(df.repartition(11)).collect()))
    assert one == many


def test_job_title_is_the_most_frequent_smallest_on_ties(spark, identities):
    rows = [event(1, title="B"), event(2, title="A"), event(3, "v", title="C"), event(4, "v", title="C"), event(5, "v", title="A")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.user_id: r.event_job_title for r in activity.usual_job_title(df).collect()} == {"u": "A", "v": "C"}
    users = spark.createDataFrame([("u", "X"), ("w", "Y")], "user_id string, job_title string")
    people = {r.user_id: r for r in activity.identities(users, activity.user_activity(df)).collect()}
    assert people["u"].job_title == "A" and people["w"].job_title == "Y" and people["w"].event_count_90d == 0


def finance_log():
    rows, i = [], 0
    for d in range(1, 32):
        for _ in range(20 if d >= 28 else 2):
            i += 1
            rows.append(event(i, f"f{i % 3}", datetime(2024, 5, d, i % 24), f"r{i % 12}", "download" if i % 4 == 0 else "read", dept="Finance", title="Analyst"))
    rows.append(event(i + 1, "f0", datetime(2024, 6, 1, 3), "r1", dept="Finance", title="Analyst"))
    rows.append(event(i + 2, "solo", datetime(2024, 6, 1, 3), "r1", dept="IT", title="Engineer"))
    rows.append(event(i + 3, "old", datetime(2022, 6, 1, 3), "r1", dept="IT", title="Gone"))
    return rows


def test_baselines(spark):
    out = {r.job_title: r for r in B.build_baselines(spark.createDataFrame(finance_log(), SCHEMA)).collect()}
    assert set(out) == {"Analyst", "Engineer"}
    f, solo = out["Analyst"], out["Engineer"]
    days = [3] + [2] * 26 + [20] * 4  # the first of June adds to day 1
    assert abs(f.month_end_multiplier - 20 / (sum(days) / 31)) < 1e-9
    assert abs(f.quarter_end_multiplier - 1 / 134) < 1e-9
    assert len(f.typical_resources) == 10 and f.typical_resources[0] == "r1" and len(f.typical_access_hours) <= 8
    assert (solo.std_events_30d, solo.month_end_multiplier, solo.p99_download_count, solo.avg_events_30d) == (0.0, 1.0, 0.0, 1.0)


def test_baseline_modes_and_zscores(spark, identities):
    schema = "department string, job_title string, " + ", ".join(f"{c} double" for c in B.PROFILE_NUMBERS)
    numbers = lambda mean, std: [mean, std] + [2.0] * (len(B.PROFILE_NUMBERS) - 2)
    profiles = spark.createDataFrame([("Finance", "CFO", *numbers(5.0, 0.0)), ("Finance", "Analyst", *numbers(4.0, 3.0))], schema)
    drop = [c for c in identities(x={}).columns if c.startswith("baseline_") or c == "has_baseline"]
    people = identities(
        a=dict(department="Finance", job_title="Analyst", roles=["viewer", "CFO"]), b=dict(department="Finance", job_title="CFO", roles=["x"]),
        c=dict(department="HR", job_title="CFO", roles=["CFO"])).drop(*drop)
    mean = lambda mode: {r.user_id: r.baseline_avg_events_30d for r in B.attach_baseline(people, profiles, mode).collect()}
    assert mean("job_title") == {"a": 4.0, "b": 5.0, "c": None}
    assert mean("role") == {"a": None, "b": None, "c": None}
    assert mean("role_then_department") == {"a": 5.0, "b": 4.0, "c": None}
    at = lambda d: F.lit(d).cast("timestamp")
    z = lambda d: {r.user_id: r.z for r in B.attach_baseline(people, profiles).select("user_id", B.behavior_zscore(at(d)).alias("z")).collect()}
    assert z("2026-06-13")["a"] == 2.0 and z("2026-06-28")["a"] == 1.0 and z("2026-06-13")["b"] == 0.0


def test_hourly_cells_give_the_same_features_titles_and_profiles(spark):
    rng = random.Random(5)
    rows = [(*r[:10], rng.choice(["IT", "Finance"]), rng.choice("ABC")) for r in random_events(11, 15, 600, 60 * 24 * 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = activity.hourly_cells(df, Thresholds())
    text = lambda out: sorted(map(str, out.select(*sorted(out.columns)).collect()))
    assert text(activity.user_activity(df)) == text(activity.user_activity(df, cells=cells))
    rounded = lambda out: text(out.select(*B.KEY, "typical_resources", "typical_access_hours", *[F.round(c, 9).alias(c) for c in B.PROFILE_NUMBERS]))
    assert rounded(B.build_baselines(df)) == rounded(B.profiles_from_cells(B.year_cells(cells)))


@pytest.mark.parametrize("share", [0.0, 0.37, 0.95, 1.0])
def test_group_quantiles_equal_numpy(spark, share):
    """One group owns most rows; what is ranked are its distinct values."""
    rng = np.random.default_rng(6)
    rows = [("big", int(v)) for v in rng.integers(0, 40, 5_000)] + [(f"g{k % 30}", int(v)) for k, v in enumerate(rng.integers(0, 1000, 400))] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    found = group_quantile(df, ["g"], "v", share, "q")
    values = defaultdict(list)
    for g, v in rows:
        if v is not None:
            values[g].append(v)
    assert {r.g: r.q for r in found.collect()} == {g: pytest.approx(np.quantile(v, share)) for g, v in values.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and plan.index("Window") < plan.index("count(1)")  # counted below the ranks
