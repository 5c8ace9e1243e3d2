"""Scalar expressions over identity columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskweave import fixed_values as fv

SECONDS_PER_DAY = 86400


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def sql_map(mapping: dict) -> str:
    return "map(" + ", ".join(sql_literal(x) for pair in mapping.items() for x in pair) + ")"


def literal_map(mapping: dict) -> Column:
    """A constant map column, parsed in one call instead of built entry by entry."""
    return F.expr(sql_map(mapping))


def lookup(mapping: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(mapping), key), F.lit(default))


def days_between(as_of: Column, then: Column) -> Column:
    """Whole elapsed days, rounded down; not a calendar-date difference."""
    micros = F.unix_micros(as_of) - F.unix_micros(then)
    return F.floor(micros / F.lit(SECONDS_PER_DAY * 1_000_000)).cast("int")


def days_since_login(as_of: Column, never: int = 999) -> Column:
    return F.coalesce(days_between(as_of, F.col("last_login")), F.lit(never))


def account_age(as_of: Column, unknown: int) -> Column:
    return F.coalesce(days_between(as_of, F.col("created_at")), F.lit(unknown))


def permission_utilization() -> Column:
    """Distinct resources used per permission held; 0 where nothing is granted."""
    held = F.size("permissions")
    return F.when(held > 0, F.col("unique_resources_accessed") / held).otherwise(F.lit(0.0))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def sensitivity_score(c: Column) -> Column:
    return lookup(fv.SENSITIVITY, F.lower(c), 1)


def region_of(location: Column, regions: dict | None = None) -> Column:
    """Broad region of a city; null where the city is not in the table."""
    return F.try_element_at(literal_map(regions or fv.REGION_BY_LOCATION), location)


def tier_of(score: Column) -> Column:
    return (
        F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")
    )


def seniority_exception(job_title: Column, roles: Column) -> Column:
    """struct(keyword, adjustment) of the strongest matching title word, else null."""
    words = F.split(F.lower(F.concat_ws("|", F.coalesce(job_title, F.lit("")), roles)), r"[\s/\\\-_|]+")
    table = F.expr("array(" + ", ".join(
        f"named_struct('weight', {abs(points)}, 'earlier', {-position}, 'keyword', '{keyword}', 'adjustment', {points})"
        for position, (keyword, points) in enumerate(fv.SENIORITY)
    ) + ")")
    best = F.array_max(F.filter(table, lambda k: F.array_contains(words, k["keyword"])))
    return F.when(
        best.isNotNull(),
        F.struct(best["keyword"].alias("keyword"), best["adjustment"].alias("adjustment")),
    )
