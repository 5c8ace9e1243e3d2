"""Writers: plain Spark tables in, files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DECISIONS = ["APPROVE", "DENY", "REVIEW"]
LEADERBOARD_COLUMNS = [
    "rank", "username", "source_system", "score", "tier", "mitre_technique",
    "primary_rule", "suppressed_rule_count", "blast_radius_applied",
]


def flat(df: DataFrame) -> DataFrame:
    """Arrays as pipe-joined text, so the table fits a CSV file."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.dataType.simpleString() == "array<string>":
            c = F.array_join(c, "|")
        elif field.dataType.simpleString().startswith(("array", "struct", "map")):
            c = F.to_json(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_baselines(baselines: DataFrame, path: str) -> None:
    baselines.write.mode("overwrite").partitionBy("department").parquet(path)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """All stored profiles; a file that cannot be read is an error."""
    spark_read = spark.read.option("ignoreCorruptFiles", False).option("basePath", path)
    table = spark_read.parquet(path)
    return table.withColumn("department", F.col("department").cast("string"))


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def feedback_rows(corrections: DataFrame) -> DataFrame:
    """Corrections to an allowed decision, with an id, the time and an open applied flag."""
    return corrections.where(F.col("corrected_decision").isin(DECISIONS)).select(
        F.expr("uuid()").alias("feedback_id"),
        "identity_id",
        "original_decision",
        "corrected_decision",
        "correction_reason",
        F.current_timestamp().alias("submitted_at"),
        F.lit(False).alias("applied_to_retraining"),
    )


def append_feedback(corrections: DataFrame, path: str) -> None:
    feedback_rows(corrections).write.mode("append").parquet(path)
