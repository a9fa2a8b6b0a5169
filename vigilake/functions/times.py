"""Timestamps: parsing, local time and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_LAST_EPOCH_S = 253_402_300_799  # end of year 9999


def parse_timestamp(text: Column) -> Column:
    """RFC 3339 text to a timestamp; junk and the year-1 "never ended" sentinel become NULL.

    Text without an offset is read in the session zone, which is UTC.
    """
    trimmed = F.trim(text)
    parsed = F.when(trimmed.rlike(_ISO_DATE), F.try_to_timestamp(trimmed))
    return F.when(F.year(parsed) > 1, parsed)


def chat_timestamp(ts: Column) -> Column:
    """Chat message id text (`seconds.micros`) to a timestamp; malformed text becomes NULL."""
    seconds = F.when(ts.rlike(_PLAIN_NUMBER), ts.try_cast("double"))
    usable = F.abs(seconds) <= F.lit(_LAST_EPOCH_S)
    return F.when(usable, F.timestamp_micros(F.bround(seconds * 1_000_000).cast("bigint")))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as a double, keeping microseconds."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def whole_seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds rounded to an integer, as the stored timing columns are."""
    return F.round(seconds_between(start, end)).cast("int")


def local_hour(ts: Column, tz: Column) -> Column:
    return F.hour(F.from_utc_timestamp(ts, tz))


def local_date(ts: Column, tz: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def as_of_literal(as_of: object) -> Column:
    """The reference instant of a query: a Column as is, anything else as a UTC literal."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def interval(amount: float | int, unit: str) -> Column:
    return F.expr(f"INTERVAL '{amount}' {unit}")


def after(ts: Column, as_of: object, days: int) -> Column:
    """Trailing-window predicate `ts > as_of - days`."""
    return ts > as_of_literal(as_of) - interval(days, "DAY")


def window_minutes(start: Column, end: Column) -> Column:
    """Length of a metric window in whole minutes: floor plus one, at least one."""
    return F.greatest(F.lit(1), (F.floor(seconds_between(start, end) / 60) + 1).cast("int"))


def incident_timings(incidents):
    """Adds `tta_seconds`, `ttm_seconds` and `mttr_seconds` from the lifecycle timestamps."""
    start = F.col("detected_at")
    return incidents.withColumns(
        {
            "tta_seconds": whole_seconds_between(start, F.col("acknowledged_at")),
            "ttm_seconds": whole_seconds_between(start, F.col("mitigated_at")),
            "mttr_seconds": whole_seconds_between(start, F.col("resolved_at")),
        }
    )
