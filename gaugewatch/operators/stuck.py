"""Stuck-value rule: too little movement inside a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugewatch.config import RunGrid, StuckValueRule
from gaugewatch.functions.columns import json_keep_nulls
from gaugewatch.operators.runs import of_tags, tag_runs, window_extrema, with_run_columns
from gaugewatch.schemas import TAG


def stuck_value(
    long: DataFrame,
    tags: list[str],
    grid: RunGrid,
    rule: StuckValueRule,
    station: str,
    source_table: str,
    extrema: DataFrame | None = None,
) -> DataFrame:
    """Judge every tag in every run window.

    Too few readings, or none, give ``skipped``; a range of at most ``max_range`` gives
    ``failed``. ``extrema`` may pass in the window aggregates when they are already there.
    """
    if extrema is None:
        extrema = window_extrema(of_tags(long, tags), grid, rule.lookback_minutes, rule.zero_filtered_tags)
    count = F.coalesce(F.col("valid_count"), F.lit(0)).cast("long")
    usable = (count >= rule.min_expected_rows) & F.col("min_value").isNotNull()
    judged = (
        tag_runs(long.sparkSession, tags, grid)
        .join(extrema.select(TAG, "run_no", "valid_count", "min_value", "max_value"), [TAG, "run_no"], "left")
        .withColumn("range_value", F.when(usable, F.col("max_value") - F.col("min_value")))
        .withColumn("valid_count", count)
        .withColumn(
            "status",
            F.when(F.col("range_value").isNull(), "skipped")
            .when(F.col("range_value") <= rule.max_range, "failed")
            .otherwise("pass"),
        )
        .withColumn(
            "observed_value",
            json_keep_nulls(
                F.col("valid_count"), F.col("min_value"), F.col("max_value"), F.col("range_value").alias("range")
            ),
        )
    )
    return with_run_columns(judged, grid, rule.lookback_minutes, station, source_table, "stuck_value")
