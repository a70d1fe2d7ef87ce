"""Small column expressions used across the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F, types as T

LOCAL_ZONE = "Pacific/Auckland"
_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def tick(name: str) -> Column:
    """Column by exact name; tags may start with a digit or hold odd characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def table_ref(*parts: str) -> str:
    """Quoted one- to three-level table name."""
    for part in parts:
        if not part or "`" in part:
            raise ValueError(f"Invalid identifier: {part!r}")
    return ".".join(f"`{part}`" for part in parts)


def is_numeric(data_type: T.DataType) -> bool:
    """By type, so small integers count and intervals do not."""
    return isinstance(data_type, T.NumericType)


def ts_lit(value: datetime | str) -> Column:
    """UTC timestamp literal."""
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp")


def half_open(ts: Column, start, end) -> Column:
    """Rule and evidence windows: start in, end out."""
    return (ts >= ts_lit(start)) & (ts < ts_lit(end))


def closed(ts: Column, start, end) -> Column:
    """Profile and history windows: both ends in."""
    return (ts >= ts_lit(start)) & (ts <= ts_lit(end))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, _TEXT_FORMAT)


def to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_text(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return utc_text(to_local(ts, zone))


def run_id(station: Column, run_ts: Column) -> Column:
    """Sorts in time order within a station."""
    return F.concat(station, F.lit("__"), F.date_format(run_ts, "yyyyMMdd_HHmmss"))


def tag_key(name: Column) -> Column:
    """Spelling-tolerant form of a tag name."""
    return F.regexp_replace(F.trim(F.lower(name)), "[^a-z0-9]+", "_")


def blank_zero(tag: Column, value: Column, zero_filtered: list[str] | tuple[str, ...]) -> Column:
    """Drop exact zeros of the tags for which zero means switched off."""
    if not zero_filtered:
        return value
    return F.when(tag.isin(*zero_filtered) & (value == 0), F.lit(None)).otherwise(value)


def window_phase(ts: Column, before_start, start, end, after_end) -> Column:
    """before / during / after, NULL outside; bounds are columns."""
    return (
        F.when((ts >= before_start) & (ts < start), "before")
        .when((ts >= start) & (ts < end), "during")
        .when((ts >= end) & (ts < after_end), "after")
    )


def null_rate(row_count: Column, non_null: Column) -> Column:
    """NULL when there are no rows at all."""
    return F.when(row_count > 0, (row_count - non_null) / row_count)


def percentiles(value: Column, probs: list[float], accuracy: int) -> Column:
    return F.percentile_approx(value, [float(p) for p in probs], accuracy)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def json_keep_nulls(*fields: Column) -> Column:
    """JSON text in which missing values stay visible."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
