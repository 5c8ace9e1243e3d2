"""Small fixed dimensions as DataFrames, and readers for their JSON forms."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave import fixed_values as fv
from riskweave.sources.tables import SchemaError

SOD_COLUMNS = "position int, conflict_id string, role_a string, role_b string, description string, severity string, compliance string"
SOD_JSON = "conflicts array<struct<conflict_id string, role_a string, role_b string, description string, severity string, compliance string>>"


def sod_conflicts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.SOD_CONFLICTS, SOD_COLUMNS)


def read_sod_conflicts(spark: SparkSession, path: str) -> DataFrame:
    """Conflict pairs from JSON, in file order; an absent path gives an empty table."""
    try:
        raw = spark.read.schema(SOD_JSON).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SOD_COLUMNS)
    return raw.select(F.posexplode("conflicts").alias("position", "c")).select(
        (F.col("position") + 1).alias("position"), "c.*"
    )


def techniques(spark: SparkSession) -> DataFrame:
    rows = [(i, n, t, fv.TECHNIQUE_URL_ROOT + i.replace(".", "/")) for i, n, t in fv.TECHNIQUES]
    return spark.createDataFrame(rows, "technique_id string, name string, tactic string, url string")


def read_techniques(spark: SparkSession, path: str) -> DataFrame:
    """Technique table from a JSON object keyed by technique id; all ids must be there."""
    entry = "struct<name string, tactic string, url string>"
    raw = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", f"map<string,{entry}>")).alias("technique_id", "t")
    )
    table = raw.select("technique_id", "t.*")
    expected = spark.createDataFrame([(i,) for i, _, _ in fv.TECHNIQUES], "technique_id string")
    absent = expected.join(table, "technique_id", "left_anti").orderBy("technique_id").take(1)
    if absent:
        raise SchemaError(absent[0][0], "technique missing, expected")
    return table


def rule_techniques(spark: SparkSession) -> DataFrame:
    rows = [(r, fv.RULE_IDS.index(r), t) for r, t in fv.RULE_TECHNIQUE.items()]
    return spark.createDataFrame(rows, "rule_id string, rule_position int, technique_id string")


def rule_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.RULE_ACTION.items()), "rule_id string, action_type string")


def actions(spark: SparkSession) -> DataFrame:
    rows = [
        (a, hours, a in fv.ACTIONS_NEEDING_APPROVAL, fv.ACTION_COMMANDS.get(a, ""))
        for a, hours in fv.ACTION_SLA_HOURS.items()
    ]
    return spark.createDataFrame(
        rows, "action_type string, expected_resolution_hours int, requires_approval boolean, template string"
    )


def disable_commands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.DISABLE_COMMANDS.items()), "source_system string, disable_template string")


def compliance_gaps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fv.COMPLIANCE_GAPS,
        "rule_id string, framework string, control_id string, control_name string, "
        "gap_description string, remediation_required string",
    )
