"""Ordered per-user operators that split a busy user's timeline into slices.

A window partitioned by user alone would put all events of one account in one
task. Here each user's time axis is cut into fixed slices; rows are ordered
inside a (user, slice) only, and what crosses a slice border is carried by one
summary row per slice. Summary rows per user are bounded by the covered time
span, not by the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave.functions.scalars import region_of
from riskweave.thresholds import DEFAULTS, Thresholds


def slice_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def cross_system_travel(
    events: DataFrame,
    thresholds: Thresholds = DEFAULTS,
    regions: dict | None = None,
    slice_seconds: int = 300,
) -> DataFrame:
    """(user_id, cross_system_impossible_travel) for every user with a dated event.

    True when two neighbouring events of a user are at most the gap apart, come
    from different source systems and lie in two different known regions.
    Neighbours are taken in (ts, event_id) order over all time.
    """
    gap_micros = int(thresholds.travel_gap_hours * 3_600_000_000)
    step = F.struct(
        F.unix_micros("ts").alias("at"),
        F.col("event_id"),
        F.coalesce("source_system", F.lit("")).alias("system"),
        region_of(F.col("location"), regions).alias("region"),
    )
    steps = events.where(F.col("ts").isNotNull()).select(
        "user_id", slice_of(F.col("ts"), slice_seconds).alias("slice"), step.alias("step")
    )

    def travelled(before: Column, after: Column) -> Column:
        hit = (
            (after["at"] - before["at"] <= gap_micros)
            & (after["system"] != before["system"])
            & (after["region"] != before["region"])
        )
        return F.coalesce(hit, F.lit(False))

    inside = W.partitionBy("user_id", "slice").orderBy("step")
    slices = (
        steps.withColumn("hit", travelled(F.lag("step").over(inside), F.col("step")))
        .groupBy("user_id", "slice")
        .agg(F.max("hit").alias("hit"), F.min("step").alias("first"), F.max("step").alias("last"))
    )
    across = W.partitionBy("user_id").orderBy("slice")
    return (
        slices.withColumn("border_hit", travelled(F.lag("last").over(across), F.col("first")))
        .groupBy("user_id")
        .agg(F.max(F.col("hit") | F.col("border_hit")).alias("cross_system_impossible_travel"))
    )
