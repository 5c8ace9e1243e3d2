"""Per-user activity features from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.operators.timeline import cross_system_travel
from riskweave.thresholds import DEFAULTS, Thresholds

COUNTS = [
    "event_count_30d", "event_count_90d", "unique_resources_accessed", "anomaly_event_count",
    "failed_attempt_count", "max_resources_in_single_session", "max_resources_in_single_day",
]
RATES = ["off_hours_event_pct", "avg_time_between_events_hours"]
FLAGS = ["impossible_travel_detected", "cross_system_impossible_travel", "bulk_download_detected"]


def event_anchor(events: DataFrame, event_as_of=None) -> Column:
    """The end of the event windows: given, or the newest event (a scalar subquery)."""
    if event_as_of is not None:
        return F.lit(event_as_of).cast("timestamp")
    return events.agg(F.max("ts")).scalar()


def days_before(anchor: Column, days: int) -> Column:
    return anchor - F.make_dt_interval(F.lit(days))


def off_hours_flag(events: DataFrame) -> Column:
    if "off_hours" in events.columns:
        return F.coalesce("off_hours", F.lit(False))
    return F.hour("ts") <= 5


SUMS = ["n30", "n90", "failed", "off_hours", "anomalies", "travel", "downloads"]


def cell_measures(events: DataFrame, thresholds: Thresholds, anchor: Column) -> list[Column]:
    """What a cell of events adds to the windowed features of its user."""
    recent = F.col("ts") >= days_before(anchor, thresholds.short_window_days)
    longer = F.col("ts") >= days_before(anchor, thresholds.long_window_days)
    return [
        F.count_if(recent).alias("n30"),
        F.count_if(longer).alias("n90"),
        F.count_if(longer & ~F.coalesce("success", F.lit(False))).alias("failed"),
        F.count_if(longer & off_hours_flag(events)).alias("off_hours"),
        F.count_if(longer & F.coalesce("is_anomaly", F.lit(False))).alias("anomalies"),
        F.count_if(longer & (F.lower("anomaly_type") == "impossible_travel")).alias("travel"),
        F.count_if(longer & (F.lower("action") == "download")).alias("downloads"),
        F.min(F.when(longer, F.unix_micros("ts"))).alias("first_us"),
        F.max(F.when(longer, F.unix_micros("ts"))).alias("last_us"),
    ]


def daily_cells(events: DataFrame, thresholds: Thresholds, event_as_of=None) -> DataFrame:
    """One row per (user, day, resource) of the raw log.

    The day and resource in the key spread a busy user's rows over the cluster,
    and map-side partial aggregation shrinks them before the shuffle.
    """
    measures = cell_measures(events, thresholds, event_anchor(events, event_as_of))
    return events.groupBy("user_id", F.to_date("ts").alias("day"), "resource").agg(*measures)


def hourly_cells(events: DataFrame, thresholds: Thresholds, event_as_of=None) -> DataFrame:
    """One row per (user, day, hour, resource), and per department and title where the log has them.

    Holds what activity features, job titles and baselines all need, so a scan
    reads and shuffles the raw log once for the three of them.
    """
    anchor = event_anchor(events, event_as_of)
    year = F.col("ts") >= days_before(anchor, thresholds.baseline_window_days)
    own = [c for c in ("department", "job_title") if c in events.columns]
    return events.groupBy("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "resource", *own).agg(
        *cell_measures(events, thresholds, anchor),
        F.count(F.lit(1)).alias("n"),
        F.count_if(year).alias("n_year"),
        F.count_if(year & (F.lower("action") == "download")).alias("downloads_year"),
    )


def merged_daily(cells: DataFrame) -> DataFrame:
    """Hourly cells merged to (user, day, resource)."""
    return cells.groupBy("user_id", "day", "resource").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def windowed_features(events: DataFrame, thresholds: Thresholds = DEFAULTS, event_as_of=None) -> DataFrame:
    """All features but travel across systems and the job title; one row per user."""
    return features_from_cells(daily_cells(events, thresholds, event_as_of), thresholds)


def features_from_cells(daily: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Cells are rolled up by (user, day) and by (user, resource) in one grouping-set
    step, so distinct counts need neither a second scan nor a join.
    """
    cells = daily.withColumn("named", F.col("resource").isNotNull())
    rolled = cells.groupingSets(
        [[F.col("user_id"), F.col("day")], [F.col("user_id"), F.col("resource")]],
        F.col("user_id"), F.col("day"), F.col("resource"),
    ).agg(
        F.grouping("day").alias("by_resource"),
        F.count_if("named").alias("cell_resources"),
        F.count_if(F.col("named") & (F.col("n90") > 0)).alias("cell_resources_90"),
        *[F.sum(c).alias(c) for c in SUMS],
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )
    by_day = F.col("by_resource") == 0
    dated = by_day & F.col("day").isNotNull()

    def total(name: str) -> Column:
        return F.sum(F.when(by_day, F.col(name)).otherwise(0))

    n90 = total("n90")
    span_hours = (F.max("last_us") - F.min("first_us")) / F.lit(3_600_000_000.0)
    return rolled.groupBy("user_id").agg(
        total("n30").alias("event_count_30d"),
        n90.alias("event_count_90d"),
        F.count_if(~by_day & (F.col("n30") > 0) & (F.col("cell_resources") > 0)).alias("unique_resources_accessed"),
        total("failed").alias("failed_attempt_count"),
        F.when(n90 > 0, total("off_hours") / n90).otherwise(F.lit(0.0)).alias("off_hours_event_pct"),
        total("anomalies").alias("anomaly_event_count"),
        (total("travel") > 0).alias("impossible_travel_detected"),
        (total("downloads") > thresholds.bulk_download_min).alias("bulk_download_detected"),
        F.coalesce(F.max(F.when(dated, F.col("cell_resources"))), F.lit(0)).alias("max_resources_in_single_day"),
        F.coalesce(F.max(F.when(dated, F.col("cell_resources_90"))), F.lit(0)).alias(
            "max_resources_in_single_session"
        ),
        # the mean gap telescopes to span / (n - 1), so no ordering is needed
        F.when(n90 > 1, span_hours / (n90 - 1)).otherwise(F.lit(0.0)).alias("avg_time_between_events_hours"),
    )


def usual_job_title(events: DataFrame) -> DataFrame:
    """Most frequent title in a user's events; the smallest one on ties."""
    return events.groupBy("user_id").agg(F.mode("job_title", deterministic=True).alias("event_job_title"))


def title_from_cells(cells: DataFrame) -> DataFrame:
    """The same as ``usual_job_title``, from hourly cells."""
    counts = cells.where("job_title is not null").groupBy("user_id", "job_title").agg(F.sum("n").alias("n"))
    return counts.groupBy("user_id").agg(
        F.min_by("job_title", F.struct(-F.col("n"), "job_title")).alias("event_job_title"))


def user_activity(
    events: DataFrame,
    thresholds: Thresholds = DEFAULTS,
    event_as_of=None,
    regions: dict | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Full activity features, one row per user seen in the log; from ``hourly_cells`` if given."""
    if cells is None:
        features = windowed_features(events, thresholds, event_as_of)
    else:
        features = features_from_cells(merged_daily(cells), thresholds)
    out = features.join(cross_system_travel(events, thresholds, regions), "user_id", "left")
    if "job_title" in events.columns:
        titles = usual_job_title(events) if cells is None else title_from_cells(cells)
        out = out.join(titles, "user_id", "left")
    return out.fillna(False, subset=["cross_system_impossible_travel"])


def identities(users: DataFrame, activity: DataFrame) -> DataFrame:
    """Inventory with activity features; users without events get zeros."""
    joined = users.join(activity, "user_id", "left")
    filled = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in COUNTS}
    filled |= {c: F.coalesce(c, F.lit(0.0)) for c in RATES}
    filled |= {c: F.coalesce(c, F.lit(False)) for c in FLAGS}
    if "event_job_title" in joined.columns:
        filled["job_title"] = F.coalesce("event_job_title", "job_title")
    return joined.withColumns(filled).drop("event_job_title")


def anomaly_mix(events: DataFrame, anomaly_types: list[str]) -> DataFrame:
    """Per user: event total, share of flagged events of the named types, count per type."""
    flagged = F.coalesce("is_anomaly", F.lit(False))
    counts = {f"n_{t}": F.count_if(flagged & (F.col("anomaly_type") == t)) for t in anomaly_types}
    named = flagged & F.col("anomaly_type").isin(anomaly_types)
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_total"),
        (F.count_if(named) / F.count(F.lit(1))).alias("anomaly_fraction"),
        *[c.alias(n) for n, c in counts.items()],
    )


def anomaly_types(events: DataFrame) -> list[str]:
    """The types that flagged events of this log carry, in alphabetical order."""
    flagged = events.where(F.coalesce("is_anomaly", F.lit(False)) & F.col("anomaly_type").isNotNull() & (F.col("anomaly_type") != ""))
    return sorted(r.anomaly_type for r in flagged.select("anomaly_type").distinct().collect())  # a vocabulary
