import json

import pytest
from pyspark.sql import functions as F

from riskweave import fixed_values as fv
from riskweave.operators import evaluation as E, reports
from riskweave.sources import dimensions, sinks, tables


def test_conflict_pairs_from_json(spark, tmp_path):
    pairs = [dict(zip(["conflict_id", "role_a", "role_b", "description", "severity", "compliance"], c[1:])) for c in fv.SOD_CONFLICTS]
    path = tmp_path / "sod.json"
    path.write_text(json.dumps({"conflicts": pairs}, indent=1))
    got = dimensions.read_sod_conflicts(spark, str(path)).orderBy("position").collect()
    assert [tuple(r) for r in got] == fv.SOD_CONFLICTS
    assert dimensions.read_sod_conflicts(spark, str(tmp_path / "absent.json")).count() == 0


def test_techniques_from_json_must_be_complete(spark, tmp_path):
    table = {i: {"name": n, "tactic": t, "url": "u"} for i, n, t in fv.TECHNIQUES}
    whole, part = tmp_path / "all.json", tmp_path / "part.json"
    whole.write_text(json.dumps(table))
    part.write_text(json.dumps({k: v for k, v in table.items() if k != "T1110"}))
    assert dimensions.read_techniques(spark, str(whole)).count() == 10
    with pytest.raises(tables.SchemaError) as error:
        dimensions.read_techniques(spark, str(part))
    assert error.value.field == "T1110"


def test_csv_reader_and_report_sink(spark, tmp_path):
    (tmp_path / "users.csv").write_text("UID,User Name,role_list\n007,Jo,a|b\n")
    users = tables.normalise_users(tables.read_table(spark, str(tmp_path / "users.csv"))).first()
    assert (users.user_id, users.username, users.roles) == ("007", "Jo", ["a", "b"])
    p = spark.createDataFrame([("1", 1, "HR"), ("2", 0, "HR")], "user_id string, is_anomaly int, department string")
    report = E.metric_report(E.join_labels(p, p.select("user_id", "is_anomaly")))
    sinks.write_report(report, str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report")).where("metric = 'overall_f1'").first()
    assert back.value == 1.0


def test_scatter_keeps_unknown_idle_time(spark):
    df = spark.createDataFrame([("a", "a", "IT", "LOW", 1, None)], "user_id string, username string, department string, tier string, score int, last_login timestamp")
    row = reports.risk_scatter(df, F.lit("2024-01-31").cast("timestamp")).first()
    assert row.days_since_login is None and row.is_outlier is False
