"""Incident reports: thresholds, trigger, windows and raw context of every incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.functions.columns import local_text, utc_text
from gaugewatch.operators.evidence import near_incidents
from gaugewatch.operators.incidents import match_logs
from gaugewatch.schemas import TAG, THRESHOLD_FIELDS, TS, VALUE

MAX_LOG_ROWS = 12
_OBSERVED = ", ".join(f"{name} double" for name in THRESHOLD_FIELDS)


def threshold_windows(matched_logs: DataFrame) -> DataFrame:
    """The six outlier measurements of each log row; rows without any, or with bad JSON, drop out."""
    read = matched_logs.withColumn("o", F.from_json("observed_value", _OBSERVED, {"mode": "PERMISSIVE"}))
    any_value = F.coalesce(*[F.col(f"o.{name}") for name in THRESHOLD_FIELDS]).isNotNull()
    return read.filter(any_value).select(
        "incident_id", "rule_type", "log_run_id", "window_start", "window_end",
        *[F.col(f"o.{name}").alias(name) for name in THRESHOLD_FIELDS],
    )


def latest_thresholds(windows: DataFrame) -> DataFrame:
    """Per incident, the measurements of its last window."""
    newest = F.max_by(F.struct(*THRESHOLD_FIELDS), F.struct("window_start", "log_run_id"))
    return windows.groupBy("incident_id").agg(newest.alias("t")).select("incident_id", "t.*")


def trigger_summary(thresholds: DataFrame) -> DataFrame:
    """Which limits the recent extremes broke; not available when one of the four is missing."""
    low, high = F.col("recent_min"), F.col("recent_max")
    below, above = low < F.col("lower_threshold"), high > F.col("upper_threshold")
    complete = (
        low.isNotNull() & high.isNotNull() & F.col("lower_threshold").isNotNull() & F.col("upper_threshold").isNotNull()
    )
    breached = F.array_compact(F.array(F.when(below, F.lit("lower")), F.when(above, F.lit("upper"))))
    return thresholds.select(
        "incident_id",
        F.when(~complete, "not_available")
        .when(below | above, "breached")
        .otherwise("not_breached")
        .alias("trigger_status"),
        F.when(complete, breached).alias("breached_thresholds"),
        "recent_min",
        "recent_max",
        "lower_threshold",
        "upper_threshold",
        F.when(complete, below).alias("below_lower_threshold"),
        F.when(complete, above).alias("above_upper_threshold"),
    )


def raw_context(long: DataFrame, incidents: DataFrame, context_seconds: int = 3600) -> DataFrame:
    """Per incident: readings within an hour of it, overall and inside the incident itself."""
    points = near_incidents(long.filter(F.col(VALUE).isNotNull()), incidents, context_seconds)
    inside = F.when(
        (F.col(TS) >= F.col("incident_start")) & (F.col(TS) <= F.col("incident_end")), F.col(VALUE)
    )
    summary = points.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
        F.min(VALUE).alias("overall_min"),
        F.max(VALUE).alias("overall_max"),
        F.avg(VALUE).alias("overall_mean"),
        F.min(inside).alias("incident_min"),
        F.max(inside).alias("incident_max"),
        F.avg(inside).alias("incident_mean"),
        F.max_by(VALUE, F.struct(TS, VALUE)).alias("latest_value"),
    )
    return incidents.select("incident_id").join(summary, "incident_id", "left").fillna(0, ["row_count"])


def first_logs(matched_logs: DataFrame, limit: int = MAX_LOG_ROWS) -> DataFrame:
    """The first log rows of each incident by window."""
    order = Window.partitionBy("incident_id").orderBy("window_start", "log_run_id")
    return (
        matched_logs.withColumn("log_rank", F.row_number().over(order))
        .filter(F.col("log_rank") <= limit)
        .select(
            "incident_id", "log_rank", "log_run_id", "window_start", "window_end", "observed_value", "log_create_ts"
        )
    )


def evidence_request(tag: Column, start: Column, end: Column, lower: Column, upper: Column) -> Column:
    """Arguments for a threshold check of the incident, when its limits are known."""
    ready = lower.isNotNull() & upper.isNotNull()
    return F.struct(
        F.when(ready, "ready").otherwise("not_ready").alias("status"),
        F.when(~ready, "outlier_thresholds unavailable in incident packet").alias("reason"),
        F.when(ready, F.array(tag)).alias("tag_names"),
        F.when(ready, utc_text(start)).alias("start_ts_utc"),
        F.when(ready, utc_text(end)).alias("end_ts_utc"),
        F.when(ready, lower).alias("lower_threshold"),
        F.when(ready, upper).alias("upper_threshold"),
    )


def _minute_nzt(ts: Column) -> Column:
    return F.concat(F.substring(local_text(ts), 1, 16), F.lit(" NZT"))


def incident_report(
    incidents: DataFrame, log: DataFrame, long: DataFrame, log_rows: int = MAX_LOG_ROWS
) -> DataFrame:
    """One row per incident with header, limits, trigger, the first ``log_rows`` log rows and raw context.

    Its threshold windows are one row each in :func:`threshold_windows`; a list of them would
    grow with the incident. ``report`` is the row as JSON text.
    """
    matched = match_logs(incidents, log)
    windows = threshold_windows(matched)
    limits = latest_thresholds(windows)
    counts = windows.groupBy("incident_id").agg(F.count(F.lit(1)).alias("threshold_window_count"))
    trigger = trigger_summary(limits).select(
        "incident_id",
        F.struct(
            F.col("trigger_status").alias("status"),
            "breached_thresholds",
            "below_lower_threshold",
            "above_upper_threshold",
        ).alias("outlier_trigger"),
    )
    logs = (
        first_logs(matched, log_rows)
        .groupBy("incident_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "log_rank",
                        "log_run_id",
                        _minute_nzt(F.col("window_start")).alias("window_start"),
                        _minute_nzt(F.col("window_end")).alias("window_end"),
                        "observed_value",
                        _minute_nzt(F.col("log_create_ts")).alias("log_create_ts"),
                    )
                )
            ).alias("quality_log_rows")
        )
    )
    numbers = ["overall_min", "overall_max", "overall_mean", "incident_min", "incident_max", "incident_mean"]
    context = raw_context(long, incidents).select(
        "incident_id",
        F.struct(
            "row_count",
            _minute_nzt(F.col("first_ts")).alias("first_timestamp_nzt"),
            _minute_nzt(F.col("last_ts")).alias("last_timestamp_nzt"),
            *[F.round(name, 6).alias(name) for name in [*numbers, "latest_value"]],
        ).alias("raw_context"),
    )
    start, end = F.col("incident_start"), F.col("incident_end")
    is_outlier = F.col("rule_type") == "outlier"
    lower = F.when(is_outlier, F.col("outlier_thresholds.lower_threshold"))
    upper = F.when(is_outlier, F.col("outlier_thresholds.upper_threshold"))
    header = F.struct(
        "incident_id", "station", "source_table", TAG, "rule_type", "status",
        F.concat(utc_text(start), F.lit(" UTC")).alias("incident_start_utc"),
        F.concat(utc_text(end), F.lit(" UTC")).alias("incident_end_utc"),
        _minute_nzt(start).alias("incident_start_nzt"),
        _minute_nzt(end).alias("incident_end_nzt"),
    )
    not_available = F.struct(
        F.lit("not_available").alias("status"),
        F.lit(None).cast("array<string>").alias("breached_thresholds"),
        F.lit(None).cast("boolean").alias("below_lower_threshold"),
        F.lit(None).cast("boolean").alias("above_upper_threshold"),
    )
    parts = [
        "incident", "outlier_thresholds", "outlier_trigger", "threshold_window_count", "evidence_request",
        "quality_log_rows", "raw_context",
    ]
    return (
        incidents.join(limits.select("incident_id", F.struct(*THRESHOLD_FIELDS).alias("outlier_thresholds")), "incident_id", "left")
        .join(counts, "incident_id", "left")
        .join(trigger, "incident_id", "left")
        .join(logs, "incident_id", "left")
        .join(context, "incident_id", "left")
        .fillna(0, ["threshold_window_count"])
        .withColumn("outlier_trigger", F.coalesce("outlier_trigger", not_available))
        .withColumn("incident", header)
        .withColumn("evidence_request", evidence_request(F.col(TAG), start, end, lower, upper))
        .select("incident_id", *parts)
        .withColumn("report", F.to_json(F.struct(F.lit("data_quality_incident").alias("analysis_type"), *parts)))
    )
