"""Behaviour baselines per (department, job title), and peer statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave.functions.quantiles import group_quantile
from riskweave.functions.salting import salted_left_join
from riskweave.operators.activity import days_before, event_anchor
from riskweave.session import shared
from riskweave.thresholds import DEFAULTS, Thresholds

KEY = ["department", "job_title"]
FINANCE = "Finance"
PROFILE_NUMBERS = [
    "avg_events_30d", "std_events_30d", "avg_events_per_session", "avg_unique_resources_30d",
    "std_unique_resources_30d", "p95_events_single_session", "p99_download_count",
    "month_end_multiplier", "quarter_end_multiplier", "avg_daily_unique_resources",
]


def baseline_cells(
    events: DataFrame,
    users: DataFrame | None = None,
    thresholds: Thresholds = DEFAULTS,
    event_as_of=None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Event counts per (department, title, user, day, hour, resource) in the trailing year.

    The raw log is read once, here. When department and title come from the
    inventory they are joined after this aggregation, so what meets the join
    are a user's hourly cells and not the user's events. ``only`` keeps the log
    of the listed user ids, and then ends the year at their newest event.
    """
    if only is not None and event_as_of is None:
        newest = events.groupBy("user_id").agg(F.max("ts").alias("ts")).join(only, "user_id", "left_semi")
        anchor = event_anchor(newest)
    else:
        anchor = event_anchor(events, event_as_of)
    year = events.where(F.col("ts") >= days_before(anchor, thresholds.baseline_window_days))
    own_key = KEY if users is None else []
    cells = year.groupBy(
        *own_key, "user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "resource"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ts") >= days_before(anchor, thresholds.short_window_days)).alias("n30"),
        F.count_if(F.lower("action") == "download").alias("downloads"),
    )
    if only is not None:
        cells = cells.join(only, "user_id", "left_semi")
    return _with_key(cells, users)


def session_stats(cells: DataFrame) -> DataFrame:
    """Events per session, a session being one user's UTC day."""
    sessions = cells.groupBy(*KEY, "user_id", "day").agg(F.sum("n").alias("n"))
    usual = sessions.groupBy(*KEY).agg(F.avg("n").alias("avg_events_per_session"))
    return usual.join(group_quantile(sessions, KEY, "n", 0.95, "p95_events_single_session"), KEY)


def user_stats(cells: DataFrame) -> DataFrame:
    """Per-user 30-day counts and downloads, summarised over the group's users."""
    per_user = cells.groupBy(*KEY, "user_id").agg(
        F.sum("n30").alias("n30"), F.sum("downloads").alias("downloads")
    )
    recent = F.when(F.col("n30") > 0, F.col("n30"))
    usual = per_user.groupBy(*KEY).agg(
        F.coalesce(F.avg(recent), F.lit(0.0)).alias("avg_events_30d"),
        F.coalesce(F.stddev_pop(recent), F.lit(0.0)).alias("std_events_30d"),
    )
    most = group_quantile(per_user.where("downloads > 0"), KEY, "downloads", 0.99, "p99_download_count")
    return usual.join(most, KEY, "left").fillna(0.0, subset=["p99_download_count"])


def resource_stats(cells: DataFrame) -> DataFrame:
    per_user = cells.where("n30 > 0").groupBy(*KEY, "user_id").agg(F.count_distinct("resource").alias("n"))
    return per_user.groupBy(*KEY).agg(
        F.avg("n").alias("avg_unique_resources_30d"), F.stddev_pop("n").alias("std_unique_resources_30d")
    )


def daily_resource_stats(cells: DataFrame) -> DataFrame:
    """Distinct resources per day over the whole group, averaged over its days."""
    per_day = cells.groupBy(*KEY, "day").agg(F.count_distinct("resource").alias("n"))
    return per_day.groupBy(*KEY).agg(F.avg("n").alias("avg_daily_unique_resources"))


def typical_hours(cells: DataFrame, top: int = DEFAULTS.top_hours) -> DataFrame:
    """Hours with at least the mean count of the hours present, busiest first."""
    hours = cells.groupBy(*KEY, "hour").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*KEY)  # at most 24 rows per group
    ranked = hours.withColumns({
        "mean": F.avg("n").over(group),
        "place": F.row_number().over(group.orderBy(F.desc("n"), "hour")),
    })
    chosen = ranked.where((F.col("n") >= F.col("mean")) & (F.col("place") <= top))
    return _ordered_list(chosen, "hour", "typical_access_hours")


def typical_resources(cells: DataFrame, top: int = DEFAULTS.top_resources) -> DataFrame:
    """Most used resources, by count then name. Spark limits each group before the shuffle."""
    counts = cells.where("resource is not null").groupBy(*KEY, "resource").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*KEY).orderBy(F.desc("n"), "resource")
    chosen = counts.withColumn("place", F.row_number().over(group)).where(F.col("place") <= top)
    return _ordered_list(chosen, "resource", "typical_resources")


def _ordered_list(ranked: DataFrame, value: str, name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("place", value)))
    return ranked.groupBy(*KEY).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def finance_multipliers(cells: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Month-end and quarter-end surges of Finance groups against their usual volume."""
    finance = cells.where(F.col("department") == FINANCE)
    days = finance.groupBy(*KEY, F.dayofmonth("day").alias("dom")).agg(F.sum("n").alias("n"))
    late = F.col("dom") >= thresholds.month_end_day
    month_end = days.groupBy(*KEY).agg(
        F.coalesce(F.avg(F.when(late, F.col("n"))) / F.avg("n"), F.lit(1.0)).alias("month_end_multiplier")
    )
    months = finance.groupBy(*KEY, F.month("day").alias("month")).agg(F.sum("n").alias("n"))
    closing = F.col("month") % 3 == 0
    quarter_end = months.groupBy(*KEY).agg(
        F.coalesce(
            F.avg(F.when(closing, F.col("n"))) / F.avg(F.when(~closing, F.col("n"))), F.lit(1.0)
        ).alias("quarter_end_multiplier")
    )
    return month_end.join(quarter_end, KEY)


def build_baselines(
    events: DataFrame,
    users: DataFrame | None = None,
    thresholds: Thresholds = DEFAULTS,
    event_as_of=None,
    computed_at=None,
    only: DataFrame | None = None,
) -> DataFrame:
    """One profile row per (department, job_title)."""
    cells = shared(baseline_cells(events, users, thresholds, event_as_of, only))
    return profiles_from_cells(cells, thresholds, computed_at)


def year_cells(cells: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Baseline cells from the hourly cells of a scan."""
    own_key = KEY if users is None else []
    year = cells.where("n_year > 0").select(
        *own_key, "user_id", "day", "hour", "resource", F.col("n_year").alias("n"), "n30",
        F.col("downloads_year").alias("downloads"))
    return _with_key(year, users)


def _with_key(cells: DataFrame, users: DataFrame | None) -> DataFrame:
    if users is None:
        return cells.where(F.col("department").isNotNull() & F.col("job_title").isNotNull())
    return cells.join(users.select("user_id", *KEY), "user_id", "left").fillna("", subset=KEY)


def profiles_from_cells(cells: DataFrame, thresholds: Thresholds = DEFAULTS, computed_at=None) -> DataFrame:
    """One profile row per (department, job_title) from baseline cells."""
    profile = session_stats(cells).join(user_stats(cells), KEY)
    for part in (
        resource_stats(cells),
        daily_resource_stats(cells),
        typical_hours(cells, thresholds.top_hours),
        typical_resources(cells, thresholds.top_resources),
        finance_multipliers(cells, thresholds),
    ):
        profile = profile.join(part, KEY, "left")
    profile = profile.fillna(0.0, subset=["avg_unique_resources_30d", "std_unique_resources_30d"])
    profile = profile.fillna(1.0, subset=["month_end_multiplier", "quarter_end_multiplier"])
    at = F.current_timestamp() if computed_at is None else F.lit(computed_at).cast("timestamp")
    return profile.withColumns({
        "typical_resources": F.coalesce("typical_resources", F.array().cast("array<string>")),
        "computed_at": at,
    })


# -- attaching a profile to an identity ---------------------------------------

def _prefixed(baselines: DataFrame) -> DataFrame:
    return baselines.select(
        *KEY, *[F.col(c).alias(f"baseline_{c}") for c in PROFILE_NUMBERS], F.lit(True).alias("has_baseline")
    )


def attach_baseline(identities: DataFrame, baselines: DataFrame, mode: str = "job_title") -> DataFrame:
    """Left-joins the profile columns as ``baseline_*`` plus ``has_baseline``.

    ``job_title`` matches the identity's title, ``role`` its first role, and
    ``role_then_department`` the first role with a profile, else the
    department's first profile by title.
    """
    profile = _prefixed(baselines)
    if mode in ("job_title", "role"):
        title = F.col("job_title") if mode == "job_title" else F.coalesce(F.get("roles", F.lit(0)), F.lit(""))
        right = profile.withColumnRenamed("job_title", "__title")
        out = salted_left_join(
            identities.withColumn("__title", title), right, ["department", "__title"], F.col("user_id")
        ).drop("__title")
    elif mode == "role_then_department":
        out = _attach_by_any_role(identities, profile)
    else:
        raise ValueError(f"unknown baseline mode: {mode}")
    return out.fillna(False, subset=["has_baseline"])


def _attach_by_any_role(identities: DataFrame, profile: DataFrame) -> DataFrame:
    columns = [c for c in profile.columns if c not in KEY]
    packed = profile.select(*KEY, F.struct(*columns).alias("__profile"))
    by_role = packed.withColumnRenamed("job_title", "__role")
    by_department = packed.groupBy("department").agg(
        F.min_by("__profile", "job_title").alias("__department_profile")
    )
    roles = identities.select("user_id", "department", F.posexplode("roles").alias("__at", "__role"))
    matched = (
        salted_left_join(roles, by_role, ["department", "__role"], F.hash("user_id", "__role"))
        .where("__profile is not null")
        .groupBy("user_id")
        .agg(F.min_by("__profile", "__at").alias("__role_profile"))
    )
    out = salted_left_join(
        identities.join(matched, "user_id", "left"), by_department, ["department"], F.col("user_id")
    )
    chosen = F.coalesce("__role_profile", "__department_profile")
    return out.withColumns({c: chosen[c] for c in columns}).drop("__role_profile", "__department_profile")


def behavior_zscore(as_of: Column, thresholds: Thresholds = DEFAULTS) -> Column:
    """30-day count against the profile; Finance month-end volume is scaled down."""
    multiplier = F.col("baseline_month_end_multiplier")
    z = F.when(
        F.col("baseline_std_events_30d") > thresholds.epsilon,
        (F.col("event_count_30d") - F.col("baseline_avg_events_30d")) / F.col("baseline_std_events_30d"),
    ).otherwise(F.lit(0.0))
    month_end = (
        (F.col("department") == FINANCE)
        & (F.dayofmonth(as_of) >= thresholds.month_end_day)
        & (multiplier > thresholds.epsilon)
    )
    return F.when(month_end, z / multiplier).otherwise(z)


def raw_zscore() -> Column:
    std = F.col("baseline_std_events_30d")
    return F.when(
        std > 0, (F.col("event_count_30d") - F.col("baseline_avg_events_30d")) / std
    ).otherwise(F.lit(0.0))


# -- peers ----------------------------------------------------------------------

def peer_stats(identities: DataFrame) -> DataFrame:
    """Mean and population deviation of 30-day counts per department."""
    return (
        identities.where(F.col("department") != "")
        .groupBy("department")
        .agg(
            F.avg("event_count_30d").alias("peer_mean"),
            F.when(F.count(F.lit(1)) > 1, F.stddev_pop("event_count_30d")).otherwise(F.lit(1.0)).alias("peer_std"),
        )
    )


def attach_peers(identities: DataFrame, peers: DataFrame) -> DataFrame:
    return salted_left_join(identities, peers, ["department"], F.col("user_id"))


def peer_deviation() -> Column:
    """Distance from the department mean in deviations; 0 where it has none."""
    return F.when(
        F.col("peer_std") > 0, (F.col("event_count_30d") - F.col("peer_mean")) / F.col("peer_std")
    ).otherwise(F.lit(0.0))


# -- monthly band -------------------------------------------------------------

def monthly_band(events: DataFrame, users: DataFrame) -> DataFrame:
    """A user's events per month against the department's mean ± 2 deviations that month."""
    monthly = events.where("ts is not null").groupBy(
        "user_id", F.date_format("ts", "yyyy-MM").alias("month")
    ).agg(F.count(F.lit(1)).alias("events"))
    monthly = monthly.join(users.select("user_id", "department"), "user_id", "left").fillna("", ["department"])
    band = monthly.groupBy("department", "month").agg(
        F.avg("events").alias("mean"), F.stddev_pop("events").alias("std")
    )
    joined = salted_left_join(monthly, band, ["department", "month"], F.col("user_id"))
    low = F.greatest(F.lit(0.0), F.col("mean") - 2 * F.col("std"))
    high = F.col("mean") + 2 * F.col("std")
    return joined.select(
        "user_id", "department", "month", "events", "mean", low.alias("band_low"), high.alias("band_high"),
        (F.col("events") > high).alias("above_band"),
    )
