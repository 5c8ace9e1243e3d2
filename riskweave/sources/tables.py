"""Readers and normalisers for the user inventory, the event log and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskweave import fixed_values as fv
from riskweave.functions import parsing as P
from riskweave.functions.salting import salted_left_join

USER_DEFAULTS = {
    "username": "",
    "email": "",
    "department": "",
    "employment_status": "active",
    "account_type": "human",
    "source_system": "",
    "job_title": "",
    "resource_sensitivity": "low",
}
_USER_FLAGS = ["mfa_enabled", "sso_linked", "is_privileged", "geo_anomaly", "interactive_login"]
_USER_COUNTS = ["login_count_30d", "login_count_90d", "systems_count", "role_changes_90d"]


class SchemaError(ValueError):
    """A needed column is missing or ambiguous; ``field`` names it."""

    def __init__(self, field: str, why: str = "missing") -> None:
        super().__init__(f"{why} column: {field}")
        self.field = field


# -- reading ----------------------------------------------------------------

def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as it is; CSV with every column as text, so nothing is inferred."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).option("escape", '"').csv(path)
    return spark.read.parquet(path)


def require_columns(df: DataFrame, *needed: str) -> DataFrame:
    for name in needed:
        if name not in df.columns:
            raise SchemaError(name)
    return df


def canonical_columns(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Lower-case, trim, underscore and alias the column names."""
    renamed: dict[str, str] = {}
    for column in df.columns:
        name = column.strip().lower().replace(" ", "_")
        renamed[column] = aliases.get(name, name)
    targets = list(renamed.values())
    for name in targets:
        if targets.count(name) > 1:
            raise SchemaError(name, "ambiguous")
    return df.withColumnsRenamed(renamed)


def is_compact(users: DataFrame, events: DataFrame | None = None) -> bool:
    """True for the short schema (privilege levels instead of flags)."""
    short = "privilege_level" in users.columns
    if events is not None:
        short = short and "time_classification" in events.columns
    return short and not {"is_privileged", "employment_status"} & set(users.columns)


# -- compact schema ---------------------------------------------------------

def expand_compact_users(users: DataFrame) -> DataFrame:
    level = F.lower(_text(users, "privilege_level", "user"))
    systems = F.coalesce(_text(users, "systems_access", ""), F.lit(""))
    active = P.parse_boolean(_text(users, "is_active", "true"), default=True)
    return users.withColumns({
        "is_privileged": level == "admin",
        "account_type": F.when(level == "service-account", "service").otherwise("human"),
        "employment_status": F.when(active, "active").otherwise("terminated"),
        "systems_count": F.when(systems == "", 0).otherwise(F.size(F.split(systems, "[|]"))),
        "source_system": F.split(systems, "[|]")[0],
        "created_at": _text(users, "hire_date", ""),
        "owner_id": F.lit(""),
        "roles": F.lit(""),
        "permissions": F.lit(""),
        "mfa_enabled": F.lit(False),
        "sso_linked": F.lit(False),
        "login_count_30d": F.lit(0),
        "login_count_90d": F.lit(0),
        "role_changes_90d": F.lit(0),
        "resource_sensitivity": F.lit("low"),
        "off_hours_access_pct": F.lit(0.0),
        "geo_anomaly": F.lit(False),
        "interactive_login": F.lit(False),
    })


def expand_compact_events(events: DataFrame) -> DataFrame:
    """Adds the fields the short log lacks. A missing event id becomes a content hash."""
    added = {
        "success": F.lower(_text(events, "status", "success")) == "success",
        "off_hours": F.lower(_text(events, "time_classification", "business_hours")).isin(fv.AFTER_HOURS_CLASSES),
        "location": F.lit(""),
        "is_anomaly": F.lit(False),
        "anomaly_type": F.lit(""),
    }
    if "event_id" not in events.columns:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(events.columns)]
        added["event_id"] = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return events.withColumns(added)


# -- normalised tables ------------------------------------------------------

def _text(df: DataFrame, name: str, default: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(default)


def _typed(df: DataFrame, name: str, kind: type, parse, default) -> Column:
    """The column itself where it has the right type already, else its parsed text."""
    if name not in df.columns:
        return F.lit(default) if not isinstance(default, Column) else default
    if isinstance(df.schema[name].dataType, kind):
        column = F.col(name)
        return column if default is None else F.coalesce(column, F.lit(default) if not isinstance(default, Column) else default)
    return parse(F.col(name))


def _timestamp(df: DataFrame, name: str) -> Column:
    null = F.lit(None).cast("timestamp")
    if name not in df.columns:
        return null
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return P.parse_timestamp(F.col(name))


def normalise_users(users: DataFrame) -> DataFrame:
    """One typed row per inventory line; rows without a user id are dropped."""
    users = canonical_columns(users, fv.USER_ALIASES)
    if is_compact(users):
        users = expand_compact_users(users)
    require_columns(users, "user_id", "username")
    no_items = F.array().cast("array<string>")
    last_login = _timestamp(users, "last_login")
    columns = {"user_id": F.col("user_id").cast("string")}
    for name, default in USER_DEFAULTS.items():
        columns[name] = F.coalesce(_text(users, name, default), F.lit(default))
    columns["owner_id"] = P.parse_owner(_text(users, "owner_id", ""))
    columns["last_login"] = last_login
    columns["created_at"] = _timestamp(users, "created_at") if "created_at" in users.columns else last_login
    for name in ("roles", "permissions"):
        columns[name] = _typed(users, name, T.ArrayType, P.parse_list, no_items)
    for name in _USER_FLAGS:
        columns[name] = _typed(users, name, T.BooleanType, P.parse_boolean, False)
    for name in _USER_COUNTS:
        columns[name] = _typed(users, name, T.IntegerType, P.parse_int, 0)
    columns["off_hours_access_pct"] = _typed(users, "off_hours_access_pct", T.DoubleType, P.parse_float, 0.0)
    named = users.select(*[c.alias(n) for n, c in columns.items()])
    return named.where((F.col("user_id") != "") & (F.lower("user_id") != "nan"))


def normalise_events(events: DataFrame) -> DataFrame:
    """One typed row per event; ``ts`` is null where the text is no timestamp."""
    events = canonical_columns(events, fv.EVENT_ALIASES)
    if "time_classification" in events.columns and "success" not in events.columns:
        events = expand_compact_events(events)
    require_columns(events, "event_id", "user_id", "timestamp")
    columns = {
        "event_id": F.col("event_id").cast("string"),
        "user_id": F.col("user_id").cast("string"),
        "ts": _timestamp(events, "timestamp"),
    }
    for name in ("resource", "action", "location", "source_system", "anomaly_type"):
        columns[name] = _text(events, name, "")
    columns["anomaly_type"] = F.coalesce(columns["anomaly_type"], F.lit(""))
    for name in ("success", "is_anomaly"):
        columns[name] = _typed(
            events, name, T.BooleanType, lambda c: P.parse_boolean(c, words=fv.EVENT_TRUE_WORDS), False
        )
    for name in ("department", "job_title", "resource_sensitivity", "time_classification"):
        if name in events.columns:
            columns[name] = F.col(name).cast("string")
    if "off_hours" in events.columns:
        columns["off_hours"] = _typed(events, "off_hours", T.BooleanType, P.parse_boolean, False)
    return events.select(*[c.alias(n) for n, c in columns.items()])


def read_labels(labels: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, is_anomaly 0/1) plus the other label columns as they are."""
    labels = require_columns(canonical_columns(labels, {}), key, "is_anomaly")
    return labels.withColumns({key: F.col(key).cast("string"), "is_anomaly": P.parse_label(F.col("is_anomaly"))})


def with_user_attributes(events: DataFrame, users: DataFrame) -> DataFrame:
    """Department and title for a log that lacks them; unknown users get blanks.

    Operators that only need them per group take ``users`` themselves and join
    after their first aggregation; this row-level form is for row-level output.
    One busy account may own much of the log, so its events are spread by event id.
    """
    kept = [c for c in events.columns if c not in ("department", "job_title")]
    home = users.select("user_id", "department", "job_title")
    joined = salted_left_join(events.select(*kept), home, ["user_id"], F.col("event_id"))
    return joined.fillna("", subset=["department", "job_title"])
