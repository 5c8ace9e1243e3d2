"""The benchmark tables seen as a user inventory and an access-event log.

``customer`` and ``events`` carry no identity fields, so they are derived by
integer arithmetic that any SQL engine evaluates the same way. Used by the
registered queries, the benchmark and the tests only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.session import use_utc

AS_OF = datetime(2024, 1, 31)


def as_of() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _pick(selector: Column, *options: str, other: str) -> Column:
    chain = None
    for i, option in enumerate(options):
        chain = F.when(selector == i, option) if chain is None else chain.when(selector == i, option)
    return chain.otherwise(other)


def lens_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_id")
    base = raw.withColumn("k", k)
    kind = F.col("event_type")
    at = F.col("ts").cast("timestamp") - F.make_dt_interval(F.col("k") * 4)
    return base.select(
        e.cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        at.alias("ts"),
        F.concat(F.lit("res_"), (F.col("k") % 20).cast("string")).alias("resource"),
        F.when(kind == "view", "read").when(kind == "click", "write").when(kind == "purchase", "download")
        .when(kind == "signup", "admin").otherwise("execute").alias("action"),
        _pick(e % 5, "Tokyo, JP", "Berlin, DE", "New York, US", "Toronto, CA", other="Nairobi, KE").alias("location"),
        _pick(e % 6, "AD", "Okta", other="AWS_IAM").alias("source_system"),
        F.when(F.col("k") < 8, "impossible_travel").when(F.col("k") < 16, "privilege_escalation")
        .when(F.col("k") < 24, "reconnaissance").when(F.col("k") < 30, "lateral_movement")
        .when(F.col("k") < 34, "bulk_download").otherwise("").alias("anomaly_type"),
        (kind != "error").alias("success"),
        (F.col("k") < 34).alias("is_anomaly"),
        _pick(F.col("k") % 4, "low", "medium", "high", other="critical").alias("resource_sensitivity"),
        F.when(F.hour(at) < 6, "night").otherwise("business_hours").alias("time_classification"),
    )


def lens_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet")
    c = F.col("c_custkey")
    segment = F.col("c_mktsegment")

    def when(condition: Column, item: str) -> Column:
        return F.when(condition, F.lit(item))

    def kept(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    def ago(days: Column) -> Column:
        return as_of() - F.make_dt_interval(days.cast("int"))

    return raw.select(
        c.cast("string").alias("user_id"),
        F.col("c_name").alias("username"),
        F.concat(F.lit("user_"), c.cast("string"), F.lit("@company.com")).alias("email"),
        F.when(segment == "HOUSEHOLD", "Finance").when(segment == "FURNITURE", "Engineering")
        .when(segment == "MACHINERY", "IT").when(segment == "BUILDING", "HR").otherwise("Sales").alias("department"),
        F.when(c % 17 == 3, "terminated").when(c % 7 == 2, "contractor").otherwise("active").alias("employment_status"),
        F.when(c % 13 == 4, "service").when(c % 11 == 5, "admin").otherwise("human").alias("account_type"),
        F.when(c % 19 == 6, "").otherwise(F.concat(F.lit("mgr_"), (c % 19).cast("string"))).alias("owner_id"),
        _pick(F.col("c_nationkey") % 6, "AD", "AzureAD", "AWS_IAM", "GCP", "Okta", other="Salesforce").alias("source_system"),
        _pick(c % 5, "Analyst", "Manager", "Director of Ops", "CFO", other="Engineer").alias("job_title"),
        F.when(c % 23 != 7, ago((37 * c) % 240)).alias("last_login"),
        ago((53 * c) % 2000).alias("created_at"),
        kept(F.lit("viewer"), when(c % 2 == 0, "reader"), when(c % 4 == 1, "finance_approver"),
             when(c % 6 == 1, "payment_executor"), when(c % 9 == 2, "admin"), when(c % 5 == 2, "auditor")).alias("roles"),
        kept(F.lit("read:all"), when(c % 8 == 3, "admin:users"), when(c % 3 == 0, "write:config"),
             when(c % 10 == 4, "deploy:prod")).alias("permissions"),
        (c % 10 < 7).alias("mfa_enabled"),
        (c % 5 < 3).alias("sso_linked"),
        (c % 9).cast("int").alias("systems_count"),
        (c % 6).cast("int").alias("role_changes_90d"),
        (c % 4 == 2).alias("is_privileged"),
        _pick(c % 4, "low", "medium", "high", other="critical").alias("resource_sensitivity"),
        ((c % 90) / F.lit(100.0)).alias("off_hours_access_pct"),
        (c % 20 == 9).alias("geo_anomaly"),
        (c % 26).isin(4, 17).alias("interactive_login"),
    )
