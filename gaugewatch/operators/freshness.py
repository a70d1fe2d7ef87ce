"""Freshness rule: is the newest reading of a table recent enough?"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gaugewatch.config import FreshnessRule, window_bounds
from gaugewatch.functions.columns import json_keep_nulls, run_id, ts_lit, utc_text
from gaugewatch.schemas import TABLE_TAG, TS

# An empty table counts as this old, so it is always stale.
EMPTY_TABLE_TS = "1900-01-01 00:00:00"


def freshness(
    table: DataFrame,
    rule: FreshnessRule,
    run_dt: datetime,
    station: str,
    source_table: str,
    as_of: datetime | None = None,
) -> DataFrame:
    """One row that compares the newest time with ``as_of`` (the current time by default)."""
    start, end = window_bounds(run_dt, rule.max_lag_minutes)
    now: Column = F.current_timestamp() if as_of is None else ts_lit(as_of)
    latest = F.coalesce(F.max(F.col(TS).cast("timestamp")), ts_lit(EMPTY_TABLE_TS))
    lag_seconds = F.floor((F.unix_micros("current_ts") - F.unix_micros("latest_batch_ts")) / 1e6)
    stale = F.col("latest_batch_ts") < F.col("current_ts") - F.expr(f"INTERVAL {rule.max_lag_minutes} MINUTES")
    return (
        table.agg(latest.alias("latest_batch_ts"))
        .withColumn("current_ts", now)
        .withColumn("late_in_minutes", lag_seconds / 60.0)
        .select(
            run_id(F.lit(station), ts_lit(run_dt)).alias("run_id"),
            F.lit(station).alias("station"),
            F.lit(source_table).alias("source_table"),
            F.lit(TABLE_TAG).alias("tag_name"),
            F.lit("freshness_lag").alias("rule_type"),
            ts_lit(start).alias("window_start"),
            ts_lit(end).alias("window_end"),
            F.when(stale, "failed").otherwise("pass").alias("status"),
            "late_in_minutes",
            "latest_batch_ts",
            "current_ts",
            json_keep_nulls(
                F.col("late_in_minutes"),
                utc_text(F.col("latest_batch_ts")).alias("latest_batch_ts"),
                utc_text(F.col("current_ts")).alias("current_ts"),
            ).alias("observed_value"),
            ts_lit(run_dt).alias("create_ts"),
        )
    )
