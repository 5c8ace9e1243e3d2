from pyspark.sql import functions as F
import pytest

from riskweave import fixed_values as fv
from riskweave.functions import parsing as P
from riskweave.sources import tables

TIMES = {
    "2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05",
    "2024-01-02T03:04:05+05:30": "2024-01-01 21:34:05", "2024-01-02 03:04:05-0200": "2024-01-02 05:04:05",
    "02/01/2024": "2024-01-02 00:00:00", "01-02-2024": "2024-01-02 00:00:00", "1700000000": "2023-11-14 22:13:20",
    "2024-1-2": "2024-01-02 00:00:00", "20240102": "2024-01-02 00:00:00", "31/02/2024": None, "2024-13-45": None,
    "soon": None, "": None, "  ": None,
}


def test_timestamps(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    out = df.select("t", P.parse_timestamp(F.col("t")).cast("string").alias("p")).collect()
    assert {r.t: r.p for r in out} == TIMES


def test_scalars(spark):
    df = spark.createDataFrame([(" Yes ", "3.9", "0.5", "a| b ||c"), ("no", "x", "1.0d", None), (None, None, "nan", "")], "b string, i string, f string, l string")
    out = df.select(P.parse_boolean(F.col("b")), P.parse_int(F.col("i")), P.parse_list(F.col("l"))).collect()
    assert [tuple(r) for r in out] == [(True, 3, ["a", "b", "c"]), (False, 0, []), (False, 0, [])]
    assert [r[0] for r in df.select(P.parse_float(F.col("f"))).collect()][:2] == [0.5, 0.0]


def test_canonical_columns_and_errors(spark):
    df = spark.createDataFrame([("1", "a", "x")], "`UID` string, ` User Name ` string, dept string")
    assert tables.canonical_columns(df, fv.USER_ALIASES).columns == ["user_id", "username", "department"]
    with pytest.raises(tables.SchemaError, match="ambiguous"):
        tables.canonical_columns(spark.createDataFrame([("1", "2")], "uid string, user_id string"), fv.USER_ALIASES)
    with pytest.raises(tables.SchemaError) as error:
        tables.require_columns(df, "nothing")
    assert error.value.field == "nothing"


def test_full_and_compact_users(spark):
    full = spark.createDataFrame(
        [("1", "a", "nan", "x|y", "TRUE", "2024-01-02"), ("nan", "b", None, None, None, None)],
        "user_id string, username string, mgr_id string, role_list string, mfa string, last_auth string")
    row = tables.normalise_users(full).collect()
    assert len(row) == 1 and row[0].owner_id == "" and row[0].roles == ["x", "y"] and row[0].mfa_enabled
    assert row[0].created_at == row[0].last_login and row[0].employment_status == "active"
    compact = spark.createDataFrame([("1", "a", "Admin", "AD|AWS", "false", "05/02/2020")],
                                    "user_id string, username string, privilege_level string, systems_access string, is_active string, hire_date string")
    assert tables.is_compact(compact) and not tables.is_compact(full)
    row = tables.normalise_users(compact).first()
    assert (row.is_privileged, row.account_type, row.employment_status, row.systems_count, row.source_system) == (True, "human", "terminated", 2, "AD")
    assert str(row.created_at) == "2020-02-05 00:00:00"


def test_events_keep_off_hours_flag_and_blank_anomaly(spark):
    raw = spark.createDataFrame([("e1", "u", "2024-01-02T03:00:00Z", "true", "maybe"), ("e2", "u", "never", "false", None)],
                                "event_id string, user_id string, timestamp string, off_hours string, success string")
    rows = tables.normalise_events(raw).orderBy("event_id").collect()
    assert rows[0].off_hours is True and rows[0].success is False and rows[0].anomaly_type == ""
    assert rows[1].ts is None


def test_labels(spark):
    raw = spark.createDataFrame([("1", " True "), ("2", "y"), ("3", None)], "user_id string, is_anomaly string")
    assert [r.is_anomaly for r in tables.read_labels(raw).orderBy("user_id").collect()] == [1, 0, 0]
