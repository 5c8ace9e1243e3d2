"""Text-to-value parsers used by the normalisers. Bad input never fails a job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskweave import fixed_values as fv

# Accepted shapes, tried in this order.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
_ISO_BASIC = r"^\d{8}$"
_DAY_FIRST = r"^\d{1,2}/\d{1,2}/\d{4}$"
_MONTH_FIRST = r"^\d{1,2}-\d{1,2}-\d{4}$"
_EPOCH = r"^[+-]?\d{1,15}([.]0*)?$"
_LOOSE_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_MAX_EPOCH = 253402300799  # 9999-12-31T23:59:59Z


def _if_like(text: Column, pattern: str, value: Column) -> Column:
    return F.when(text.rlike(pattern), value)


def parse_timestamp(raw: Column) -> Column:
    """ISO-8601, dd/MM/yyyy, MM-dd-yyyy, epoch seconds, yyyy-M-d; else null. Naive means UTC."""
    text = F.trim(raw.cast("string"))
    # "+0530" becomes "+05:30", the only offset spelling the cast reads
    iso = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(iso)
    seconds = F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("bigint")
    epoch = F.when(F.abs(seconds) <= _MAX_EPOCH, F.timestamp_seconds(seconds))
    return F.coalesce(
        _if_like(text, _ISO, iso.try_cast("timestamp")),
        _if_like(text, _ISO_BASIC, F.try_to_timestamp(text, F.lit("yyyyMMdd"))),
        _if_like(text, _DAY_FIRST, F.try_to_timestamp(text, F.lit("d/M/yyyy"))),
        _if_like(text, _MONTH_FIRST, F.try_to_timestamp(text, F.lit("M-d-yyyy"))),
        _if_like(text, _EPOCH, epoch),
        _if_like(text, _LOOSE_ISO_DATE, F.try_to_timestamp(text, F.lit("yyyy-M-d"))),
    )


def parse_boolean(raw: Column, default: bool = False, words: list[str] | None = None) -> Column:
    words = fv.TRUE_WORDS if words is None else words
    return F.coalesce(F.lower(F.trim(raw.cast("string"))).isin(words), F.lit(default))


def _as_double(raw: Column) -> Column:
    text = F.trim(raw.cast("string"))
    return F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))


def parse_int(raw: Column, default: int = 0) -> Column:
    number = _as_double(raw)
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("int"), F.lit(default))


def parse_float(raw: Column, default: float = 0.0) -> Column:
    return F.coalesce(_as_double(raw), F.lit(default))


def parse_list(raw: Column) -> Column:
    """Pipe-separated text to an array of trimmed, non-blank items."""
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), "[|]"), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def parse_owner(raw: Column) -> Column:
    text = F.coalesce(raw, F.lit(""))
    return F.when(text.isin("", "nan", "None"), F.lit("")).otherwise(text)


def parse_label(raw: Column) -> Column:
    return parse_boolean(raw, words=fv.LABEL_TRUE_WORDS).cast("int")
