"""DuckDB statements that give the registered queries' results from the same tables."""

from __future__ import annotations

from riskweave import fixed_values as fv

CTE: dict[str, str] = {}

CTE["ev"] = """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS eid, CAST(user_id AS VARCHAR) AS user_id,
  ts - to_days(4 * k) AS ts, k, 'res_' || CAST(k % 20 AS VARCHAR) AS resource,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'download'
    WHEN 'signup' THEN 'admin' ELSE 'execute' END AS action,
  CASE event_id % 5 WHEN 0 THEN 'Tokyo, JP' WHEN 1 THEN 'Berlin, DE' WHEN 2 THEN 'New York, US'
    WHEN 3 THEN 'Toronto, CA' ELSE 'Nairobi, KE' END AS location,
  CASE event_id % 5 WHEN 0 THEN 'Asia-Pacific' WHEN 1 THEN 'Europe' WHEN 2 THEN 'North America'
    WHEN 3 THEN 'North America' END AS region,
  CASE event_id % 6 WHEN 0 THEN 'AD' WHEN 1 THEN 'Okta' ELSE 'AWS_IAM' END AS source_system,
  CASE WHEN k < 8 THEN 'impossible_travel' WHEN k < 16 THEN 'privilege_escalation'
    WHEN k < 24 THEN 'reconnaissance' WHEN k < 30 THEN 'lateral_movement'
    WHEN k < 34 THEN 'bulk_download' ELSE '' END AS anomaly_type,
  event_type <> 'error' AS success, k < 34 AS is_anomaly,
  CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS resource_sensitivity
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""

CTE["us"] = """
SELECT c_custkey AS c, CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username,
  'user_' || CAST(c_custkey AS VARCHAR) || '@company.com' AS email,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Finance' WHEN 'FURNITURE' THEN 'Engineering'
    WHEN 'MACHINERY' THEN 'IT' WHEN 'BUILDING' THEN 'HR' ELSE 'Sales' END AS department,
  CASE WHEN c_custkey % 17 = 3 THEN 'terminated' WHEN c_custkey % 7 = 2 THEN 'contractor' ELSE 'active' END AS employment_status,
  CASE WHEN c_custkey % 13 = 4 THEN 'service' WHEN c_custkey % 11 = 5 THEN 'admin' ELSE 'human' END AS account_type,
  CASE WHEN c_custkey % 19 = 6 THEN '' ELSE 'mgr_' || CAST(c_custkey % 19 AS VARCHAR) END AS owner_id,
  CASE c_nationkey % 6 WHEN 0 THEN 'AD' WHEN 1 THEN 'AzureAD' WHEN 2 THEN 'AWS_IAM' WHEN 3 THEN 'GCP'
    WHEN 4 THEN 'Okta' ELSE 'Salesforce' END AS source_system,
  CASE c_custkey % 5 WHEN 0 THEN 'Analyst' WHEN 1 THEN 'Manager' WHEN 2 THEN 'Director of Ops'
    WHEN 3 THEN 'CFO' ELSE 'Engineer' END AS job_title,
  CASE WHEN c_custkey % 23 <> 7 THEN (37 * c_custkey) % 240 END AS idle,
  (53 * c_custkey) % 2000 AS age,
  ['viewer'] || CASE WHEN c_custkey % 2 = 0 THEN ['reader'] ELSE [] END || CASE WHEN c_custkey % 4 = 1 THEN ['finance_approver'] ELSE [] END
    || CASE WHEN c_custkey % 6 = 1 THEN ['payment_executor'] ELSE [] END || CASE WHEN c_custkey % 9 = 2 THEN ['admin'] ELSE [] END
    || CASE WHEN c_custkey % 5 = 2 THEN ['auditor'] ELSE [] END AS roles,
  ['read:all'] || CASE WHEN c_custkey % 8 = 3 THEN ['admin:users'] ELSE [] END || CASE WHEN c_custkey % 3 = 0 THEN ['write:config'] ELSE [] END
    || CASE WHEN c_custkey % 10 = 4 THEN ['deploy:prod'] ELSE [] END AS permissions,
  c_custkey % 10 < 7 AS mfa_enabled, c_custkey % 5 < 3 AS sso_linked, c_custkey % 9 AS systems_count,
  c_custkey % 6 AS role_changes, c_custkey % 4 = 2 AS is_privileged,
  CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS resource_sensitivity,
  c_custkey % 4 + 1 AS sensitivity, (c_custkey % 90) / 100.0 AS off_hours,
  c_custkey % 20 = 9 AS geo_anomaly, c_custkey % 26 IN (4, 17) AS interactive
FROM customer"""

CTE["cut"] = "SELECT max(ts) AS m, max(ts) - to_days(30) AS c30, max(ts) - to_days(90) AS c90, max(ts) - to_days(365) AS c365 FROM ev"

CTE["travel"] = """
SELECT user_id, bool_or(coalesce(epoch_us(ts) - epoch_us(pts) <= 10800000000 AND source_system <> psrc AND region <> preg, false)) AS cross_travel
FROM (SELECT *, lag(ts) OVER w AS pts, lag(source_system) OVER w AS psrc, lag(region) OVER w AS preg
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id"""

CTE["act"] = """
SELECT user_id,
  count(*) FILTER (ts >= c30) AS n30, count(*) FILTER (ts >= c90) AS n90,
  count(DISTINCT CASE WHEN ts >= c30 THEN resource END) AS res30,
  count(*) FILTER (ts >= c90 AND NOT success) AS failed,
  CASE WHEN count(*) FILTER (ts >= c90) > 0 THEN
    count(*) FILTER (ts >= c90 AND hour(ts) < 6) / CAST(count(*) FILTER (ts >= c90) AS DOUBLE) ELSE 0.0 END AS off_pct,
  count(*) FILTER (ts >= c90 AND is_anomaly) AS anomalies,
  count(*) FILTER (ts >= c90 AND anomaly_type = 'impossible_travel') > 0 AS travel,
  count(*) FILTER (ts >= c90 AND action = 'download') AS downloads,
  CASE WHEN count(*) FILTER (ts >= c90) > 1 THEN
    (max(epoch_us(ts)) FILTER (ts >= c90) - min(epoch_us(ts)) FILTER (ts >= c90)) / 3600000000.0
      / (count(*) FILTER (ts >= c90) - 1) ELSE 0.0 END AS gap_h
FROM ev, cut GROUP BY user_id"""

CTE["peak"] = """
SELECT user_id, max(n) AS day_peak, coalesce(max(n90), 0) AS session_peak FROM (
  SELECT user_id, CAST(ts AS DATE) AS d, count(DISTINCT resource) AS n,
    count(DISTINCT CASE WHEN ts >= c90 THEN resource END) AS n90
  FROM ev, cut GROUP BY 1, 2) GROUP BY user_id"""

CTE["fe"] = "SELECT * FROM act JOIN peak USING (user_id) JOIN travel USING (user_id)"

CTE["year"] = "SELECT e.*, u.department, u.job_title, c30 FROM ev e JOIN us u USING (user_id), cut WHERE e.ts >= c365"

CTE["bl"] = """
SELECT s.department, s.job_title, avg_sess, p95, coalesce(a30, 0.0) AS a30, coalesce(s30, 0.0) AS s30,
  coalesce(p99, 0.0) AS p99, coalesce(ar, 0.0) AS ar, coalesce(sr, 0.0) AS sr, ad,
  coalesce(me, 1.0) AS me, coalesce(qe, 1.0) AS qe
FROM (SELECT department, job_title, avg(n) AS avg_sess, quantile_cont(n, 0.95) AS p95 FROM
        (SELECT department, job_title, user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM year GROUP BY ALL) GROUP BY ALL) s
LEFT JOIN (SELECT department, job_title, avg(n) AS a30, stddev_pop(n) AS s30, avg(r) AS ar, stddev_pop(r) AS sr FROM
        (SELECT department, job_title, user_id, count(*) AS n, count(DISTINCT resource) AS r FROM year WHERE ts >= c30 GROUP BY ALL)
        GROUP BY ALL) u USING (department, job_title)
LEFT JOIN (SELECT department, job_title, quantile_cont(n, 0.99) AS p99 FROM
        (SELECT department, job_title, user_id, count(*) AS n FROM year WHERE action = 'download' GROUP BY ALL) GROUP BY ALL) p
        USING (department, job_title)
LEFT JOIN (SELECT department, job_title, avg(n) AS ad FROM
        (SELECT department, job_title, CAST(ts AS DATE) AS d, count(DISTINCT resource) AS n FROM year GROUP BY ALL) GROUP BY ALL) d
        USING (department, job_title)
LEFT JOIN fin USING (department, job_title)"""

CTE["fin"] = """
SELECT department, job_title, coalesce(me, 1.0) AS me, coalesce(qe, 1.0) AS qe FROM
 (SELECT department, job_title, avg(n) FILTER (d >= 28) / avg(n) AS me FROM
   (SELECT department, job_title, day(ts) AS d, count(*) AS n FROM year WHERE department = 'Finance' GROUP BY ALL) GROUP BY ALL) a
 JOIN (SELECT department, job_title, avg(n) FILTER (m % 3 = 0) / avg(n) FILTER (m % 3 <> 0) AS qe FROM
   (SELECT department, job_title, month(ts) AS m, count(*) AS n FROM year WHERE department = 'Finance' GROUP BY ALL) GROUP BY ALL) b
 USING (department, job_title)"""

CTE["ppl"] = """
SELECT u.*, coalesce(n30, 0) AS n30, coalesce(n90, 0) AS n90, coalesce(res30, 0) AS res30, coalesce(failed, 0) AS failed,
  coalesce(off_pct, 0.0) AS off_pct, coalesce(anomalies, 0) AS anomalies, coalesce(travel, false) AS travel,
  coalesce(downloads, 0) AS downloads, coalesce(gap_h, 0.0) AS gap_h, coalesce(day_peak, 0) AS day_peak,
  coalesce(session_peak, 0) AS session_peak, coalesce(cross_travel, false) AS cross_travel,
  coalesce(idle, 999) AS idle0
FROM us u LEFT JOIN fe USING (user_id)"""

CTE["peers"] = "SELECT department, avg(n30) AS pm, CASE WHEN count(*) > 1 THEN stddev_pop(n30) ELSE 1.0 END AS ps FROM ppl GROUP BY department"

CTE["joined"] = """
SELECT p.*, pm, ps, CASE WHEN ps > 0 THEN (n30 - pm) / ps ELSE 0.0 END AS peer_dev,
  bl.avg_sess IS NOT NULL AS has_bl, p95, a30, s30, ar, ad, me,
  CASE WHEN s30 > 0 THEN (n30 - a30) / s30 ELSE 0.0 END AS raw_z,
  CASE WHEN s30 > 1e-8 THEN (n30 - a30) / s30 ELSE 0.0 END / CASE WHEN department = 'Finance' AND me > 1e-8 THEN me ELSE 1.0 END AS z0,
  res30 / CAST(len(permissions) AS DOUBLE) AS util,
  CASE WHEN n30 > 0 THEN anomalies / CAST(n30 AS DOUBLE) ELSE 0.0 END AS arate,
  list_concat(roles, permissions) AS held
FROM ppl p JOIN peers USING (department) LEFT JOIN bl USING (department, job_title)"""

# thresholds of the registered scans: more than 2 downloads, at least 3 resources a day
CTE["ruled"] = """
SELECT *, coalesce(z0, 0.0) AS z,
  CAST(idle0 > 30 AND is_privileged AS INT) AS r1,
  CAST(owner_id = '' OR employment_status = 'terminated' AS INT) AS r2,
  CAST(util < 0.20 AS INT) AS r3,
  CAST(account_type <> 'admin' AND list_contains(permissions, 'admin:users') AS INT) AS r4,
  CAST(role_changes >= 3 AS INT) AS r5,
  CAST(account_type = 'service' AND interactive AS INT) AS r6,
  CAST(systems_count >= 5 AND NOT sso_linked AS INT) AS r7,
  CAST(travel AS INT) AS r8, CAST(cross_travel AS INT) AS r9,
  CAST(coalesce(has_bl AND res30 > p95 AND arate > 0.30, false) AS INT) AS r10,
  CAST(coalesce(has_bl AND day_peak >= 3 AND ad > 0 AND day_peak >= ad * 1.5, false) AS INT) AS r11,
  CAST(downloads > 2 AND off_pct > 0.25 AS INT) AS r12,
  CAST((list_contains(held, 'finance_approver') AND list_contains(held, 'payment_executor'))
    OR (list_contains(held, 'admin') AND list_contains(held, 'auditor')) AS INT) AS r13,
  CAST(idle0 BETWEEN 30 AND 180 AND is_privileged AND employment_status = 'active' AND owner_id <> '' AS INT) AS s1,
  CAST(role_changes >= 1 AS INT) AS s2,
  CAST(coalesce(has_bl AND age <= 30 AND systems_count > ar, false) AS INT) AS s3,
  CAST(coalesce(has_bl AND account_type = 'service' AND off_hours > 0.70 AND NOT interactive AND n30 > 20 AND raw_z < 2.0, false) AS INT) AS s4,
  CAST(coalesce(has_bl AND department = 'Finance' AND raw_z > 2.0, false) AS INT) AS s5,
  CAST(travel OR cross_travel AS INT) AS s6,
  CAST(employment_status = 'contractor' AND off_hours > 0.30 AS INT) AS s7,
  CASE c % 5 WHEN 2 THEN -15 WHEN 3 THEN -20 ELSE 0 END AS senior
FROM joined"""

CTE["muted"] = """
SELECT *, r3 * (1 - s3) AS a3, r5 * (1 - s2) AS a5, r6 * (1 - s4) AS a6, r10 * (1 - s5) AS a10, r11 * (1 - s2) AS a11,
  r3 * s3 + r5 * s2 + r6 * s4 + r10 * s5 + r11 * s2 AS n_muted
FROM ruled"""

_ACTIVE = ["r1", "r2", "a3", "r4", "a5", "a6", "r7", "r8", "r9", "a10", "a11", "r12", "r13"]
_NAMED = list(zip(_ACTIVE, fv.RULE_IDS))


def _case(column: str, name: str) -> str:
    return f"CASE WHEN {column} = 1 THEN '{name}' END"


def _joined_names(pairs) -> str:
    return "concat_ws('|', " + ", ".join(_case(c, n) for c, n in pairs) + ")"


_FIRED = [(f"r{i + 1}", n) for i, n in enumerate(fv.RULE_IDS)]
_MUTED = [("r3 * s3", "OVER_PRIVILEGED"), ("r5 * s2", "PRIVILEGE_CREEP"), ("r6 * s4", "SERVICE_ACCT_ABUSE"),
          ("r10 * s5", "EXCESSIVE_ACCESS"), ("r11 * s2", "LATERAL_MOVEMENT_SPIKE")]
_WEIGHTS = " + ".join(f"{c} * {fv.RULE_WEIGHTS[n]}" for c, n in _NAMED)
_COUNT = " + ".join(_ACTIVE)
_PRIMARY = "coalesce(" + ", ".join(_case(c, n) for c, n in _NAMED) + ", '')"
_TECHNIQUE = "coalesce(" + ", ".join(_case(c, fv.RULE_TECHNIQUE[n]) for c, n in _NAMED if n in fv.RULE_TECHNIQUE) + ", '')"

CTE["sc"] = f"""
SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM (SELECT *, {_COUNT} AS n_active, {_WEIGHTS} AS base,
  -10 * s1 - 5 * s2 - 10 * s3 - 15 * s4 - 20 * s5 + s6 * CASE WHEN cross_travel THEN 30 ELSE 25 END AS delta,
  CAST(greatest(0, least(100, round_even(CAST(
    (({_WEIGHTS}) + least(10.0, peer_dev * 5.0)
      + (-10 * s1 - 5 * s2 - 10 * s3 - 15 * s4 - 20 * s5 + s6 * CASE WHEN cross_travel THEN 30 ELSE 25 END) + senior)
      * CASE WHEN ({_COUNT}) >= 3 THEN CAST(1.2 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS DOUBLE), 0))) AS BIGINT) AS score,
  least(0.99, 0.5 + ({_COUNT}) * CAST(0.08 AS DOUBLE) + z * CAST(0.05 AS DOUBLE)) AS confidence,
  {_joined_names(_NAMED)} AS contributing, {_joined_names(_FIRED)} AS fired, {_joined_names(_MUTED)} AS suppressed,
  {_PRIMARY} AS primary_rule, {_TECHNIQUE} AS technique
FROM muted)"""

_NEEDS = {
    "ev": [], "us": [], "cut": ["ev"], "travel": ["ev"], "act": ["ev", "cut"], "peak": ["ev", "cut"],
    "fe": ["act", "peak", "travel"], "year": ["ev", "us", "cut"], "fin": ["year"], "bl": ["year", "fin"],
    "ppl": ["us", "fe"], "peers": ["ppl"], "joined": ["ppl", "peers", "bl"], "ruled": ["joined"],
    "muted": ["ruled"], "sc": ["muted"],
}


def _sql(body: str, *ctes: str) -> str:
    """``body`` with the named common tables and what they need in front of it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in ctes:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in ordered]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _provider_ctes() -> str:
    return """
pv AS (
  SELECT 'okta' AS provider, 'ok' || c AS external_id, email, CASE c % 4 WHEN 0 THEN 'suspended' WHEN 1 THEN 'inactive' ELSE 'active' END AS status, 1 AS pr FROM us WHERE c % 3 = 0
  UNION ALL SELECT 'azuread', 'az' || c, CASE WHEN c % 8 = 0 THEN 'guest_' || c || '@other.org' ELSE email END,
    CASE WHEN c % 5 = 0 THEN 'inactive' ELSE 'active' END, 2 FROM us WHERE c % 4 = 0
  UNION ALL SELECT 'aws_iam', 'aw' || c, email, CASE WHEN c % 10 = 0 THEN 'inactive' ELSE 'active' END, 3 FROM us WHERE c % 5 = 0)"""


def _with_providers(body: str) -> str:
    return f"WITH us AS ({CTE['us']}), {_provider_ctes()} {body}"


def oracle_statements() -> dict[str, str]:
    o: dict[str, str] = {}

    # -- normalisation --------------------------------------------------------
    o["multi_format_timestamps"] = _sql("""
SELECT eid % 8 AS shape, count(*) AS n, count(x) AS parsed, CAST(min(epoch(x)) AS BIGINT) AS first_second, CAST(max(epoch(x)) AS BIGINT) AS last_second FROM (
 SELECT eid, CASE eid % 8 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE
  WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('second', ts)
  WHEN 5 THEN date_trunc('day', ts) END AS x FROM ev) GROUP BY 1""", "ev")
    o["compact_users"] = _sql("""
SELECT user_id, CAST(c % 4 = 1 AS BIGINT) AS is_privileged, CASE WHEN c % 4 = 3 THEN 'service' ELSE 'human' END AS account_type,
  CASE WHEN c % 3 <> 0 THEN 'active' ELSE 'terminated' END AS employment_status,
  CASE WHEN c % 7 = 0 THEN 0 ELSE c % 3 + 1 END AS systems_count, CASE WHEN c % 7 = 0 THEN '' ELSE source_system END AS source_system,
  strftime(TIMESTAMP '2024-01-31' - to_days(CAST(age AS INT)), '%Y-%m-%d') AS created_on, '' AS owner_id, 0::BIGINT AS n_roles
FROM us""", "us")
    o["compact_events"] = _sql("""
SELECT user_id, count(*) AS events, count(*) FILTER (success) AS succeeded, count(*) FILTER (hour(ts) < 6) AS off_hours,
 count(DISTINCT event_id) AS distinct_ids FROM ev GROUP BY 1""", "ev")

    # -- activity ---------------------------------------------------------------
    o["event_features_30_90"] = _sql("""
SELECT user_id, n30 AS event_count_30d, n90 AS event_count_90d, res30 AS unique_resources_accessed, failed AS failed_attempt_count,
 round(off_pct, 6) AS off_hours_event_pct, anomalies AS anomaly_event_count, CAST(travel AS BIGINT) AS impossible_travel_detected,
 CAST(downloads > 2 AS BIGINT) AS bulk_download_detected, round(gap_h, 6) AS avg_time_between_events_hours FROM act""", "act")
    o["cross_system_travel"] = _sql("SELECT user_id, CAST(cross_travel AS BIGINT) AS cross_system_impossible_travel FROM travel", "travel")
    o["daily_resource_peaks"] = _sql("SELECT user_id, day_peak AS max_resources_in_single_day, session_peak AS max_resources_in_single_session FROM peak", "peak")
    o["usual_job_title"] = _sql("""
SELECT user_id, job_title AS event_job_title FROM (SELECT user_id, t AS job_title, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, t) AS rn
FROM (SELECT user_id, CASE k % 3 WHEN 0 THEN 'Analyst' WHEN 1 THEN 'Engineer' ELSE 'Manager' END AS t FROM ev) GROUP BY user_id, t) WHERE rn = 1""", "ev")
    kinds = ["bulk_download", "impossible_travel", "lateral_movement", "privilege_escalation", "reconnaissance"]
    o["anomaly_mix"] = _sql("SELECT user_id, count(*) AS event_total, round(count(*) FILTER (is_anomaly) / CAST(count(*) AS DOUBLE), 6) AS anomaly_fraction, "
        + ", ".join(f"count(*) FILTER (anomaly_type = '{k}') AS n_{k}" for k in kinds) + " FROM ev GROUP BY 1", "ev")

    # -- baselines ----------------------------------------------------------------
    o["baseline_profiles"] = _sql("""
SELECT department, job_title, round(a30, 6) AS avg_events_30d, round(s30, 6) AS std_events_30d, round(avg_sess, 6) AS avg_events_per_session,
 round(ar, 6) AS avg_unique_resources_30d, round(sr, 6) AS std_unique_resources_30d, round(p95, 6) AS p95_events_single_session,
 round(p99, 6) AS p99_download_count, round(me, 6) AS month_end_multiplier, round(qe, 6) AS quarter_end_multiplier,
 round(ad, 6) AS avg_daily_unique_resources FROM bl""", "bl")
    o["finance_multipliers"] = _sql("SELECT department, job_title, round(me, 6) AS month_end_multiplier, round(qe, 6) AS quarter_end_multiplier FROM fin", "fin")
    o["typical_hours_topk"] = _sql("""
SELECT department, job_title, string_agg(CAST(h AS VARCHAR), '|' ORDER BY n DESC, h) AS typical_access_hours FROM (
 SELECT *, avg(n) OVER (PARTITION BY department, job_title) AS m, row_number() OVER (PARTITION BY department, job_title ORDER BY n DESC, h) AS rn
 FROM (SELECT department, job_title, hour(ts) AS h, count(*) AS n FROM year GROUP BY ALL)) WHERE n >= m AND rn <= 8 GROUP BY 1, 2""", "year")
    o["typical_resources_topk"] = _sql("""
SELECT department, job_title, string_agg(resource, '|' ORDER BY n DESC, resource) AS typical_resources FROM (
 SELECT *, row_number() OVER (PARTITION BY department, job_title ORDER BY n DESC, resource) AS rn
 FROM (SELECT department, job_title, resource, count(*) AS n FROM year GROUP BY ALL)) WHERE rn <= 10 GROUP BY 1, 2""", "year")
    o["peer_stats"] = _sql("SELECT department, round(pm, 6) AS peer_mean, round(ps, 6) AS peer_std FROM peers", "peers")
    o["behavior_zscore"] = _sql("SELECT user_id, CAST(has_bl AS BIGINT) AS has_baseline, round(coalesce(z0, 0.0), 6) AS behavior_zscore, round(peer_dev, 6) AS peer_deviation_score FROM joined", "joined")
    o["baseline_by_any_role"] = _sql("""
SELECT p.user_id, CAST(b.department IS NOT NULL AS BIGINT) AS has_baseline, round(b.a30, 6) AS baseline_avg_events_30d
FROM ppl p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY department ORDER BY job_title) AS rn FROM bl) b
 ON p.department = b.department AND b.rn = 1""", "ppl", "bl")
    o["monthly_band"] = _sql("""
SELECT user_id, department, month, n AS events, round(m, 6) AS mean, round(greatest(0.0, m - 2 * s), 6) AS band_low, round(m + 2 * s, 6) AS band_high,
 CAST(n > m + 2 * s AS BIGINT) AS above_band FROM (
 SELECT *, avg(n) OVER (PARTITION BY department, month) AS m, stddev_pop(n) OVER (PARTITION BY department, month) AS s FROM (
 SELECT user_id, u.department, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM ev JOIN us u USING (user_id) GROUP BY ALL))""", "ev", "us")

    # -- features, rules, context, score ------------------------------------------
    feats = {
        "days_since_login": "idle0", "permission_utilization": "least(1.0, util)", "role_count": "len(roles)",
        "system_count": "systems_count", "role_change_velocity": "role_changes / 90.0", "is_privileged_flag": "CAST(is_privileged AS INT)",
        "has_owner_flag": "CAST(owner_id <> '' AS INT)", "hr_mismatch_flag": "CAST(employment_status = 'terminated' AS INT)",
        "off_hours_access_pct": "off_hours", "geo_anomaly_flag": "CAST(geo_anomaly AS INT)", "sso_linked_flag": "CAST(sso_linked AS INT)",
        "mfa_enabled_flag": "CAST(mfa_enabled AS INT)", "sensitivity_score": "sensitivity", "behavior_zscore": "peer_dev",
        "account_age_days": "age", "event_anomaly_rate": "CASE WHEN n90 > 0 THEN anomalies / CAST(n90 AS DOUBLE) ELSE 0.0 END",
        "failed_attempt_rate": "CASE WHEN n90 > 0 THEN failed / CAST(n90 AS DOUBLE) ELSE 0.0 END", "unique_resources_30d": "res30",
        "bulk_download_flag": "CAST(downloads > 2 AS INT)", "impossible_travel_flag": "CAST(travel AS INT)",
        "after_hours_event_pct": "off_pct", "peer_deviation_score": "peer_dev", "avg_time_between_events_h": "gap_h",
    }
    o["feature_vector"] = _sql("SELECT user_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in feats.items()) + " FROM joined", "joined")
    pv, un, en, ch, idle = "CAST(is_privileged AS INT)", "CAST(owner_id = '' AS INT)", "CAST(employment_status = 'terminated' AS INT)", "CAST(role_changes AS DOUBLE)", "(idle0 / 999.0)"
    disc = {
        "disc_privileged": pv, "disc_unowned": un, "disc_ended": en, "disc_role_changes": ch,
        "disc_systems_without_sso": "systems_count * CAST(NOT sso_linked AS INT)", "disc_privileged_idle": f"{pv} * {idle}",
        "disc_privileged_unowned_idle": f"{pv} * {un} * {idle}", "disc_privileged_ended_idle": f"{pv} * {en} * {idle}",
        "disc_privileged_creep": f"{pv} * CAST(role_changes >= 3 AS INT)", "disc_unowned_idle": f"{idle} * {un}",
    }
    o["discriminators"] = _sql("SELECT user_id, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in disc.items()) + " FROM joined", "joined")
    o["rule_flags"] = _sql("SELECT user_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {n}" for c, n in _FIRED) + " FROM ruled", "ruled")
    o["sod_violations"] = _sql("""
SELECT user_id, concat_ws('|', CASE WHEN f THEN 'SOD-001' END, CASE WHEN a THEN 'SOD-002' END) AS conflict_ids FROM (
SELECT user_id, list_contains(roles, 'finance_approver') AND list_contains(roles, 'payment_executor') AS f,
 list_contains(roles, 'admin') AND list_contains(roles, 'auditor') AS a FROM us) WHERE f OR a""", "us")
    signals = ["SABBATICAL_POSSIBLE", "TEMP_ELEVATION", "NEW_HIRE_RAMP", "BATCH_JOB_PATTERN", "MONTH_END_FINANCE", "IMPOSSIBLE_TRAVEL_CONFIRMED", "CONTRACTOR_NORM"]
    o["context_signals"] = _sql("SELECT user_id, " + _joined_names([(f"s{i + 1}", n) for i, n in enumerate(signals)])
        + " AS signals, CAST(delta AS BIGINT) AS context_delta, suppressed FROM sc", "sc")
    o["seniority_exceptions"] = _sql("SELECT user_id, CASE c % 5 WHEN 2 THEN 'director' ELSE 'cfo' END AS keyword, CAST(CASE c % 5 WHEN 2 THEN -15 ELSE -20 END AS BIGINT) AS adjustment FROM us WHERE c % 5 IN (2, 3)", "us")
    score_columns = """user_id, department, score, tier, contributing AS contributing_factors, suppressed AS suppressed_factors, fired AS anomaly_types,
 primary_rule, technique AS mitre_technique, CAST(n_muted AS BIGINT) AS suppressed_rule_count, CAST(n_active >= 3 AS BIGINT) AS blast_radius_applied,
 round(z, 6) AS behavior_zscore, round(confidence, 6) AS confidence, round(peer_dev, 6) AS peer_deviation_score"""
    o["risk_scores"] = _sql(f"SELECT {score_columns} FROM sc", "sc")
    o["scan_leaderboard"] = _sql(f"SELECT row_number() OVER (ORDER BY score DESC, user_id) AS rank, {score_columns} FROM sc ORDER BY score DESC, user_id LIMIT 20", "sc")

    # -- remediation, techniques, compliance -----------------------------------------
    def plan(columns: str, tail: str = "") -> str:
        severity = {n: s for n, s, _ in fv.RULES}
        parts = [
            f"SELECT user_id, score, username, email, source_system, {fv.SEVERITY_REDUCTION[severity[n]]} AS red, {i} AS ord, '{fv.RULE_ACTION[n]}' AS act FROM sc WHERE {c} = 1"
            for i, (c, n) in enumerate(_NAMED) if n in fv.RULE_ACTION
        ]
        parts.append("SELECT user_id, score, username, email, source_system, 5, 100, 'VERIFY_WITH_MANAGER' FROM sc WHERE s1 = 1")
        parts.append("SELECT user_id, score, username, email, source_system, 10, 101, 'ENABLE_MFA' FROM sc WHERE NOT mfa_enabled")
        disable = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.DISABLE_COMMANDS.items())
        other = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.ACTION_COMMANDS.items())
        sla = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.ACTION_SLA_HOURS.items())
        return _sql(f"""
SELECT {columns} FROM (SELECT user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY red DESC, ord) AS priority, act AS action_type,
 replace(replace(replace(CASE WHEN act = 'DISABLE_ACCOUNT' THEN CASE source_system {disable} ELSE '{fv.DISABLE_COMMAND_OTHER}' END
   ELSE CASE act {other} END END, '{{username}}', username), '{{email}}', email), '{{source_system}}', source_system) AS machine_actionable_command,
 CAST(red AS BIGINT) AS estimated_risk_reduction, CAST(CASE act {sla} END AS BIGINT) AS expected_resolution_hours,
 CAST(act IN ('DISABLE_ACCOUNT', 'REVOKE_ROLE') AS BIGINT) AS requires_approval
 FROM ({' UNION ALL '.join(parts)})) {tail}""", "sc")

    o["remediation_plan"] = plan("user_id, score, priority, action_type, machine_actionable_command, estimated_risk_reduction, expected_resolution_hours, requires_approval")
    o["remediation_sample"] = plan("rank, user_id, priority, action_type, expected_resolution_hours",
        "JOIN (SELECT user_id, row_number() OVER (ORDER BY score DESC, user_id) AS rank FROM sc) USING (user_id) WHERE rank <= 20 AND priority <= 2 ORDER BY rank, priority LIMIT 10")
    by_id = {t: (n, k) for t, n, k in fv.TECHNIQUES}
    o["identity_techniques"] = _sql(" UNION ALL ".join(
        f"SELECT user_id, '{fv.RULE_TECHNIQUE[n]}' AS technique_id, '{by_id[fv.RULE_TECHNIQUE[n]][0]}' AS name, '{by_id[fv.RULE_TECHNIQUE[n]][1]}' AS tactic, '{n}' AS triggered_by_rule FROM sc WHERE {c} = 1"
        for c, n in _NAMED if n in fv.RULE_TECHNIQUE), "sc")
    gaps = {g[0]: g for g in fv.COMPLIANCE_GAPS}
    o["compliance_gaps"] = _sql("SELECT department, framework, control_id, count(*) AS identities FROM (" + " UNION ALL ".join(
        f"SELECT department, '{gaps[n][1]}' AS framework, '{gaps[n][2]}' AS control_id FROM sc WHERE {c} = 1" for c, n in _NAMED if n in gaps)
        + ") GROUP BY ALL", "sc")

    # -- sequences, exports, access ---------------------------------------------------
    def chains(hours: int) -> str:
        return _sql(f"""
, w AS (SELECT a.user_id, a.event_id, a.ts, count(DISTINCT b.anomaly_type) AS d, list(DISTINCT b.anomaly_type) AS t
  FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {hours} HOUR GROUP BY ALL),
 p AS (SELECT *, CASE WHEN d < 3 THEN NULL
   WHEN list_has_all(t, ['reconnaissance', 'privilege_escalation', 'lateral_movement', 'bulk_download']) THEN 'recon_to_exfil'
   WHEN list_contains(t, 'lateral_movement') THEN 'lateral_movement'
   WHEN list_has_all(t, ['privilege_escalation', 'reconnaissance']) THEN 'privilege_escalation_chain'
   WHEN list_contains(t, 'impossible_travel') THEN 'impossible_travel_sequence' END AS pattern, least(0.95, 0.5 + d * CAST(0.1 AS DOUBLE)) AS conf FROM w),
 b AS (SELECT user_id, pattern, conf, row_number() OVER (PARTITION BY user_id ORDER BY conf DESC, ts) AS rn FROM p WHERE pattern IS NOT NULL)
SELECT u.user_id, CAST(b.pattern IS NOT NULL AS BIGINT) AS pattern_detected, b.pattern AS pattern_type, round(coalesce(b.conf, 0.0), 6) AS sequence_confidence
FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN b ON u.user_id = b.user_id AND rn = 1""", "ev")
    o["attack_chains"] = chains(2)
    o["attack_chains_72h"] = chains(72)
    o["exfiltration_alerts"] = _sql("""
SELECT user_id, u.username, CASE WHEN s >= 30 THEN 'CRITICAL' WHEN s >= 20 THEN 'HIGH' WHEN s >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 n AS total_exports, late AS after_hours_exports, sens AS sensitive_resource_count, s AS exfiltration_score FROM (
 SELECT *, n + 2 * late + sens * CASE WHEN crit > 0 THEN 4 ELSE 3 END AS s FROM (
  SELECT user_id, count(*) AS n, count(*) FILTER (hour(ts) < 6) AS late, count(*) FILTER (k % 4 >= 2) AS sens, count(*) FILTER (k % 4 = 3) AS crit
  FROM ev WHERE action = 'download' GROUP BY 1) WHERE n >= 5) JOIN us u USING (user_id)""", "ev", "us")
    rates = """, m AS (SELECT DISTINCT u.user_id, u.department FROM us u JOIN ev USING (user_id)),
 rt AS (SELECT department, resource, action, n AS users_with_access, peers, n / CAST(peers AS DOUBLE) AS rate FROM
 (SELECT department, resource, action, count(DISTINCT user_id) AS n FROM ev JOIN m USING (user_id) GROUP BY ALL)
 JOIN (SELECT department, count(*) AS peers FROM m GROUP BY 1) USING (department)) """
    o["peer_access_rate"] = _sql(rates + "SELECT department, resource, action, users_with_access, peers, round(rate, 6) AS peer_access_rate FROM rt", "ev", "us")
    o["access_decisions"] = _sql(rates + """
SELECT user_id, department, resource, action, round(coalesce(rate, 0.0), 6) AS peer_access_rate,
 CASE WHEN rate > 0.8 THEN 'APPROVE' WHEN rate > 0.4 THEN 'REVIEW' ELSE 'DENY' END AS decision,
 CASE WHEN rate > 0.8 THEN 0.95 WHEN rate > 0.4 THEN 0.65 WHEN rate > 0 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence
FROM (SELECT user_id, department, 'res_' || CAST(c % 23 AS VARCHAR) AS resource, CASE c % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'admin' ELSE 'download' END AS action FROM us)
LEFT JOIN rt USING (department, resource, action)""", "ev", "us")
    matrix = """
SELECT user_id, resource AS feature, round(count(*) / CAST(any_value(t) AS DOUBLE), 6) AS share FROM ev JOIN (SELECT user_id, count(*) AS t FROM ev GROUP BY 1) USING (user_id) GROUP BY user_id, resource
UNION ALL SELECT user_id, 'action_diversity', round(count(DISTINCT action) / CAST(count(*) AS DOUBLE), 6) FROM ev GROUP BY 1
UNION ALL SELECT user_id, 'department_' || department, round(1 / CAST(count(*) AS DOUBLE), 6) FROM ev JOIN us USING (user_id) GROUP BY user_id, department"""
    o["access_matrix"] = _sql(matrix, "ev", "us")
    o["access_vectors"] = _sql(f", m AS ({matrix}), v AS (SELECT feature, dense_rank() OVER (ORDER BY feature) - 1 AS i FROM (SELECT DISTINCT feature FROM m)) SELECT user_id, CAST(i AS BIGINT) AS i, feature, share FROM m JOIN v USING (feature)", "ev", "us")

    # -- reports ------------------------------------------------------------------------
    o["tier_distribution"] = _sql("""
SELECT CAST(t.o AS BIGINT) AS tier_order, t.tier, count(sc.tier) AS identities, round(count(sc.tier) * 100.0 / (SELECT count(*) FROM sc), 6) AS percentage
FROM (VALUES (1, 'CRITICAL'), (2, 'HIGH'), (3, 'MEDIUM'), (4, 'LOW')) t(o, tier) LEFT JOIN sc ON sc.tier = t.tier GROUP BY ALL""", "sc")
    o["department_risk"] = _sql("""
SELECT department, count(*) AS user_count, count(*) FILTER (tier = 'CRITICAL') AS critical_count, count(*) FILTER (tier = 'HIGH') AS high_count,
 round_even(avg(score), 1) AS avg_score, round_even((2 * count(*) FILTER (tier = 'CRITICAL') + count(*) FILTER (tier = 'HIGH')) * 100.0 / count(*), 1) AS risk_percentage FROM sc GROUP BY 1""", "sc")
    o["organization_risk"] = _sql("SELECT count(DISTINCT department) AS departments, round_even(avg(score), 1) AS organization_risk FROM sc", "sc")
    o["primary_rule_top8"] = _sql("SELECT primary_rule, count(*) AS identities FROM sc WHERE primary_rule <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "sc")
    o["anomaly_type_counts"] = _sql(" UNION ALL ".join(f"SELECT '{n}' AS anomaly_type, count(*) AS identities FROM ruled WHERE {c} = 1 HAVING count(*) > 0" for c, n in _FIRED), "ruled")
    o["technique_counts"] = _sql("SELECT technique AS mitre_technique, count(*) AS identities FROM sc WHERE technique <> '' GROUP BY 1", "sc")
    mapping = " UNION ALL ".join(f"SELECT '{n}' AS rule_id, '{t}' AS technique_id, '{by_id[t][0]}' AS name, '{by_id[t][1]}' AS tactic" for n, t in fv.RULE_TECHNIQUE.items())
    o["technique_table"] = _sql(f"SELECT technique_id, name, tactic, rule_id AS triggered_by_rule FROM ({mapping}) WHERE rule_id IN (SELECT primary_rule FROM sc)", "sc")
    o["executive_summary"] = _sql("""
SELECT count(*) AS identities, count(*) FILTER (tier = 'CRITICAL') AS critical, count(*) FILTER (tier = 'HIGH') AS high, count(*) FILTER (tier = 'MEDIUM') AS medium,
 count(*) FILTER (tier = 'LOW') AS low, round(avg(score), 6) AS avg_score, round(avg(confidence), 6) AS avg_confidence FROM sc""", "sc")
    o["leaderboard_page"] = _sql("SELECT row_number() OVER (ORDER BY score DESC, user_id) AS rank, user_id, score, tier FROM sc WHERE department = 'Finance' ORDER BY score DESC, user_id LIMIT 25 OFFSET 25", "sc")
    o["leaderboard_page_count"] = _sql("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages FROM sc WHERE department = 'Finance'", "sc")
    o["leaderboard_rank_all"] = _sql("SELECT row_number() OVER (ORDER BY score DESC, user_id) AS rank, user_id, score FROM sc", "sc")
    o["leaderboard_export"] = _sql("""
SELECT row_number() OVER (ORDER BY score DESC, user_id) AS rank, username, source_system, score, tier, technique AS mitre_technique, primary_rule,
 CAST(n_muted AS BIGINT) AS suppressed_rule_count, CASE WHEN n_active >= 3 THEN 'Yes' ELSE 'No' END AS blast_radius_applied
FROM sc WHERE tier IN ('CRITICAL', 'HIGH') AND r8 = 1 AND email LIKE '%user_1%'""", "sc")
    o["filter_values"] = _sql("SELECT DISTINCT 'tier' AS filter, tier AS value FROM sc UNION ALL SELECT DISTINCT 'source_system', source_system FROM sc UNION ALL SELECT DISTINCT 'department', department FROM sc UNION ALL "
        + " UNION ALL ".join(f"SELECT 'anomaly_type', '{n}' FROM sc WHERE {c} = 1 HAVING count(*) > 0" for c, n in _FIRED), "sc")
    o["identity_lookup"] = _sql("SELECT user_id, username, department, score, tier FROM sc WHERE user_id = '42'", "sc")
    o["risk_scatter"] = _sql("SELECT user_id, department, tier, score, idle AS days_since_login, CAST(coalesce(idle > 120, false) AS BIGINT) AS is_outlier, CAST(tier IN ('CRITICAL', 'HIGH') AS BIGINT) AS marked FROM sc", "sc")

    # -- graph ----------------------------------------------------------------------------
    o["graph_edges"] = _sql("""
SELECT type, target, count(*) AS edges, count(DISTINCT source) AS users FROM (
SELECT user_id AS source, 'role:' || unnest(roles) AS target, 'user_role' AS type FROM us UNION ALL SELECT user_id, 'system:' || source_system, 'user_system' FROM us
UNION ALL SELECT user_id, 'resource:' || unnest(permissions), 'user_resource' FROM us) GROUP BY ALL""", "us")
    o["graph_nodes"] = _sql("""
SELECT user_id AS id, username AS label, 'user' AS type, tier, score, CAST(NOT is_privileged AND account_type <> 'admin' AND list_contains(permissions, 'admin:users') AS BIGINT) AS shadow_admin FROM sc
UNION ALL SELECT DISTINCT 'role:' || r, r, 'role', NULL, NULL, NULL FROM (SELECT unnest(roles) AS r FROM us)
UNION ALL SELECT DISTINCT 'system:' || source_system, source_system, 'system', NULL, NULL, NULL FROM us
UNION ALL SELECT DISTINCT 'resource:' || r, r, 'resource', NULL, NULL, NULL FROM (SELECT unnest(permissions) AS r FROM us)""", "sc")
    # a sparser inventory, so that reach differs between users
    reach = """, gu AS (SELECT user_id, CASE WHEN c % 7 = 6 THEN [] ELSE ['role_' || CAST(c % 40 AS VARCHAR), 'role_' || CAST((c * 3) % 40 AS VARCHAR)] END AS roles,
  'sys_' || CAST(c % 8 AS VARCHAR) AS source_system, ['perm_' || CAST(c % 16 AS VARCHAR)] AS permissions FROM us),
 ur AS (SELECT DISTINCT user_id, unnest(roles) AS role FROM gu), rs AS (SELECT DISTINCT unnest(roles) AS role, source_system AS system FROM gu),
 sr AS (SELECT DISTINCT source_system AS system, unnest(permissions) AS resource FROM gu WHERE len(roles) > 0),
 uss AS (SELECT DISTINCT user_id, system FROM ur JOIN rs USING (role)), usr AS (SELECT DISTINCT user_id, resource FROM uss JOIN sr USING (system)),
 dn AS (SELECT a.user_id, count(DISTINCT b.user_id) - 1 AS n FROM uss a JOIN uss b USING (system) GROUP BY 1) """
    o["blast_radius"] = _sql(reach + """
SELECT g.user_id AS identity_id, coalesce(s.l, '') AS systems_at_risk, coalesce(r.l, '') AS sensitive_resources, coalesce(dn.n, 0) AS downstream_user_count,
 CAST(least(100, 5 * coalesce(s.n, 0) + 15 * coalesce(r.n, 0)) AS BIGINT) AS estimated_impact_score FROM gu g
 LEFT JOIN (SELECT user_id, string_agg(system, '|' ORDER BY system) AS l, count(*) AS n FROM uss GROUP BY 1) s USING (user_id)
 LEFT JOIN (SELECT user_id, string_agg(resource, '|' ORDER BY resource) AS l, count(*) AS n FROM usr GROUP BY 1) r USING (user_id)
 LEFT JOIN dn USING (user_id)""", "us")
    o["downstream_users"] = _sql(reach + "SELECT DISTINCT b.user_id FROM uss a JOIN uss b USING (system) WHERE a.user_id = '5' AND b.user_id <> '5'", "us")

    # -- providers ------------------------------------------------------------------------
    o["provider_summary"] = _with_providers("SELECT provider, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status <> 'active') AS inactive FROM pv GROUP BY 1")
    o["provider_match"] = _with_providers("""SELECT user_id, b.provider, b.external_id, b.status AS provider_status, CAST(b.provider IS NOT NULL AS BIGINT) AS matched FROM us LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY email ORDER BY pr, external_id) AS rn FROM pv) b ON us.email = b.email AND rn = 1""")
    o["provider_unmatched"] = _with_providers("SELECT 'internal' AS side, user_id AS id FROM us WHERE email NOT IN (SELECT email FROM pv) UNION ALL SELECT 'provider', external_id FROM pv WHERE email NOT IN (SELECT email FROM us)")
    o["provider_matched_count"] = _with_providers("SELECT count(DISTINCT email) AS matched_emails FROM us WHERE email IN (SELECT email FROM pv)")
    o["credential_metrics"] = _sql("""
SELECT count(*) AS total_report_users, count(*) FILTER (c % 10 >= 7) AS users_with_mfa_disabled, count(*) FILTER (c % 3 = 0) AS users_with_password_enabled,
 count(*) FILTER (c % 4 = 1) + count(*) FILTER (c % 6 = 1) AS users_with_active_access_keys, count(*) FILTER (c % 4 = 1) AS users_with_access_key_1_active,
 count(*) FILTER (c % 6 = 1) AS users_with_access_key_2_active, count(*) FILTER (idle > 90) AS users_with_password_unused_90d,
 count(*) FILTER (c % 4 = 1 AND age > 90) AS users_with_access_key_1_unused_90d, 0::BIGINT AS users_with_access_key_2_unused_90d FROM us""", "us")
    o["privileged_by_policy"] = _sql("SELECT user_id FROM us WHERE c % 8 = 3 OR c % 9 = 2", "us")
    o["access_keys"] = _sql("""
SELECT username AS UserName, CAST(c % 4 = 1 AS BIGINT) + CAST(c % 6 = 1 AS BIGINT) AS active_keys, CAST(c % 4 = 1 AND c % 6 = 1 AS BIGINT) AS key_sprawl FROM us""", "us")
    o["access_key_summary"] = _sql("""
SELECT 2 * count(*) AS total_keys, count(*) FILTER (c % 4 = 1) + count(*) FILTER (c % 6 = 1) AS active_keys,
 2 * count(*) - count(*) FILTER (c % 4 = 1) - count(*) FILTER (c % 6 = 1) AS inactive_keys, 1::BIGINT AS key_sprawl_detected FROM us""", "us")
    o["feedback_summary"] = _sql("SELECT count(*) AS total_corrections, count(*) AS pending_corrections FROM us WHERE c % 4 < 3", "us")

    # -- evaluation -------------------------------------------------------------------------
    ev = ", j AS (SELECT department, CAST(c % 6 = 2 AS INT) AS t, CAST(score >= 60 AS INT) AS p FROM sc) "
    f1 = "coalesce(2.0 * count(*) FILTER (t = {x} AND p = {x}) / nullif(count(*) FILTER (t = {x}) + count(*) FILTER (p = {x}), 0), 0.0)"
    a, b = f1.format(x=0), f1.format(x=1)
    o["user_metrics"] = _sql(ev + f"""
SELECT count(*) AS rows, round({b}, 6) AS overall_f1, round(({a} + {b}) / 2, 6) AS macro_f1,
 round(({a} * count(*) FILTER (t = 0) + {b} * count(*) FILTER (t = 1)) / count(*), 6) AS weighted_f1,
 round(count(*) FILTER (t = 0 AND p = 1) * 1.0 / count(*) FILTER (t = 0), 6) AS false_positive_rate FROM j""", "sc")
    o["user_confusion"] = _sql(ev + "SELECT CAST(t AS VARCHAR) AS true, CAST(p AS VARCHAR) AS pred, count(*) AS n FROM j GROUP BY 1, 2", "sc")
    o["fpr_by_department"] = _sql(ev + "SELECT department, round(count(*) FILTER (t = 0 AND p = 1) * 1.0 / count(*) FILTER (t = 0), 6) AS false_positive_rate FROM j GROUP BY 1", "sc")
    o["metric_gate"] = _sql(ev + f"SELECT CAST({b} > 0.75 AS BIGINT) AS f1_met, CAST(count(*) FILTER (t = 0 AND p = 1) * 1.0 / count(*) FILTER (t = 0) < 0.20 AS BIGINT) AS fpr_met, CAST({b} > 0.75 AND count(*) FILTER (t = 0 AND p = 1) * 1.0 / count(*) FILTER (t = 0) < 0.20 AS BIGINT) AS passed FROM j", "sc")
    o["evaluation_status"] = _sql("SELECT count(*) AS rows, count(*) FILTER (c % 6 = 2) AS label_match_count, 'ok' AS status FROM us", "us")
    o["event_confusion"] = _sql(", j AS (SELECT CAST(k < 34 AS INT) AS t, CAST(score >= 60 AS INT) AS p FROM ev JOIN sc USING (user_id)) SELECT CAST(t AS VARCHAR) AS true, CAST(p AS VARCHAR) AS pred, count(*) AS n FROM j GROUP BY 1, 2", "ev", "sc")
    o["event_class_metrics"] = _sql("""
, j AS (SELECT anomaly_type AS t, CASE WHEN eid % 7 = 0 THEN 'reconnaissance' WHEN eid % 11 = 0 THEN '' ELSE anomaly_type END AS p FROM ev),
 x AS (SELECT c AS class, sum(s) AS support, sum(q) AS predicted, sum(tp) AS tp FROM (
  SELECT t AS c, count(*) AS s, 0 AS q, count(*) FILTER (t = p) AS tp FROM j GROUP BY t UNION ALL SELECT p, 0, count(*), 0 FROM j GROUP BY p) GROUP BY c)
SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp,
 round(CASE WHEN predicted > 0 THEN tp * 1.0 / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0 END, 6) AS recall,
 round(CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0 END, 6) AS f1 FROM x""", "ev")
    o["stratified_split"] = _sql("""
SELECT label, is_test, CAST(CASE WHEN is_test = 1 THEN floor(n * 0.2) ELSE n - floor(n * 0.2) END AS BIGINT) AS n
FROM (SELECT CAST(c % 6 = 2 AS BIGINT) AS label, count(*) AS n FROM us GROUP BY 1), (SELECT unnest([0::BIGINT, 1::BIGINT]) AS is_test)""", "us")
    o["smote_balance"] = _sql("SELECT label, greatest(p, q) AS n FROM (SELECT count(*) FILTER (c % 6 = 2) AS p, count(*) FILTER (c % 6 <> 2) AS q FROM us), (SELECT unnest([0::BIGINT, 1::BIGINT]) AS label)", "us")
    o["lof_neighbours"] = """
WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n, sum(CAST(o_totalprice AS DOUBLE)) AS spent FROM orders GROUP BY 1),
 p AS (SELECT c_custkey AS c, CAST(c_acctbal AS DOUBLE) / 1000 AS x, round(coalesce(spent, 0), 2) / 100000 AS y, CAST(coalesce(n, 0) AS DOUBLE) AS z FROM customer LEFT JOIN o USING (c_custkey)),
 d AS (SELECT p.c, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM p, p AS q WHERE p.c <> q.c),
 r AS (SELECT c, d, row_number() OVER (PARTITION BY c ORDER BY d) AS rn FROM d)
SELECT CAST(c AS VARCHAR) AS user_id, round(d, 6) AS k_distance FROM r WHERE rn = 20"""
    return {name: " ".join(sql.split()) for name, sql in o.items()}
