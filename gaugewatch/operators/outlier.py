"""Outlier rule: recent extremes against limits from a fenced trailing history."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from gaugewatch.config import OutlierRule, RunGrid
from gaugewatch.functions.columns import json_keep_nulls
from gaugewatch.operators.ranks import group_quantiles, join_on
from gaugewatch.operators.runs import of_tags, tag_runs, window_extrema, with_run_columns
from gaugewatch.operators.trailing import fenced_history_percentiles, fences
from gaugewatch.schemas import TAG, VALUE


def iqr_fences(readings: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Quartiles and 1.5-IQR fences per tag; exact unless an ``accuracy`` is given."""
    lower, upper = fences(F.col("history_q1"), F.col("history_q3"))
    quartiles = group_quantiles(readings, [TAG], {"history_q1": 0.25, "history_q3": 0.75}, VALUE, accuracy)
    return quartiles.withColumn("lower_fence", lower).withColumn("upper_fence", upper)


def fenced_percentiles(readings: DataFrame, bounds: DataFrame, accuracy: int | None = None) -> DataFrame:
    """p1 and p99 of the values inside each tag's fences; exact unless an ``accuracy`` is given.

    ``bounds`` has one row per tag; staged, it is broadcast only if it is small.
    """
    kept = join_on(readings, bounds, [TAG]).filter(F.col(VALUE).between(F.col("lower_fence"), F.col("upper_fence")))
    return group_quantiles(kept, [TAG], {"history_p1": 0.01, "history_p99": 0.99}, VALUE, accuracy)


def outlier(
    long: DataFrame,
    tags: list[str],
    grid: RunGrid,
    rule: OutlierRule,
    station: str,
    source_table: str,
    extrema: DataFrame | None = None,
    fanout: int = 256,
    levels: int | None = None,
) -> DataFrame:
    """Judge every tag in every run window; one run and a grid of runs go the same exact way."""
    runs = tag_runs(long.sparkSession, tags, grid)
    watched = of_tags(long, tags)
    history = timedelta(days=rule.history_days)
    limits = fenced_history_percentiles(watched, runs, grid, rule.lookback_minutes, history, fanout, levels)
    if extrema is None:
        extrema = window_extrema(watched, grid, rule.lookback_minutes)
    judged = (
        runs.join(extrema.select(TAG, "run_no", "recent_min", "recent_max"), [TAG, "run_no"], "left")
        .join(limits.select(TAG, "run_no", "history_p1", "history_p99"), [TAG, "run_no"], "left")
    )
    judged = judge_limits(judged, rule.outlier_multiplier)
    return with_run_columns(judged, grid, rule.lookback_minutes, station, source_table, "outlier")


def judge_limits(measured: DataFrame, multiplier: float) -> DataFrame:
    """Limits, status and JSON from recent extremes and history percentiles.

    The upper limit is p99 times the multiplier, so for a negative p99 it lies below p99;
    the lower limit always lies below p1. Breaches are strict, and NaN never breaches.
    """
    p1, p99 = F.col("history_p1"), F.col("history_p99")
    low, high = F.col("recent_min"), F.col("recent_max")
    complete = low.isNotNull() & high.isNotNull() & p1.isNotNull() & p99.isNotNull()
    breach = ((high > F.col("upper_threshold")) & ~F.isnan(high)) | (low < F.col("lower_threshold"))
    short = json_keep_nulls(low, high, p1, p99)
    full = json_keep_nulls(low, high, p1, p99, F.col("lower_threshold"), F.col("upper_threshold"))
    return (
        measured.withColumn("upper_threshold", F.when(complete, p99 * multiplier))
        .withColumn("lower_threshold", F.when(complete, p1 - F.abs(p1) * (multiplier - 1.0)))
        .withColumn("status", F.when(~complete, "skipped").when(breach, "failed").otherwise("pass"))
        .withColumn("observed_value", F.when(complete, full).otherwise(short))
    )
