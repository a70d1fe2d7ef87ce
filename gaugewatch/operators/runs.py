"""Run grid, per-window aggregates and the common shape of rule results."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gaugewatch.config import RunGrid
from gaugewatch.functions.columns import blank_zero, run_id
from gaugewatch.schemas import MONITOR_LOG, TAG, TS, VALUE
from gaugewatch.session import local_frame


def origin_seconds(grid: RunGrid) -> Column:
    return F.unix_seconds(F.lit(grid.origin.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))


def at_minutes(grid: RunGrid, minutes) -> Column:
    """Timestamp so many minutes after the grid's origin."""
    minutes = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.timestamp_seconds(origin_seconds(grid) + minutes * 60)


def cell_index(grid: RunGrid, cell_minutes: int, ts: Column | None = None) -> Column:
    """Number of the fixed time cell a reading falls in, relative to the origin."""
    ts = F.col(TS) if ts is None else ts
    return F.floor((F.unix_seconds(ts) - origin_seconds(grid)) / (60 * cell_minutes))


def tag_frame(spark: SparkSession, tags) -> DataFrame:
    return local_frame(spark, [(tag,) for tag in tags], T.StructType([T.StructField(TAG, T.StringType())]))


def of_tags(long: DataFrame, tags) -> DataFrame:
    """Readings of the given tags; the condition reaches the scan."""
    return long.filter(F.col(TAG).isin(list(tags)))


def tag_runs(spark: SparkSession, tags, grid: RunGrid) -> DataFrame:
    """One row per tag and run, so that tags without readings are judged too."""
    return tag_frame(spark, tags).select(TAG, F.explode(F.sequence(F.lit(1), F.lit(grid.count))).alias("run_no"))


def window_extrema(
    long: DataFrame, grid: RunGrid, lookback_minutes: int, zero_filtered: tuple[str, ...] = ()
) -> DataFrame:
    """Count, min and max per tag and run window.

    Readings are first reduced to fixed cells with map-side combine; only the cells are
    spread over the (possibly overlapping) windows that contain them.
    """
    cell = gcd(grid.step_minutes, lookback_minutes)
    step = grid.step_minutes // cell
    span = lookback_minutes // cell
    kept = blank_zero(F.col(TAG), F.col(VALUE), zero_filtered)
    cells = (
        long.filter(
            (F.col(TS) >= at_minutes(grid, grid.step_minutes - lookback_minutes))
            & (F.col(TS) < at_minutes(grid, grid.step_minutes * grid.count))
        )
        .groupBy(TAG, cell_index(grid, cell).alias("cell"))
        .agg(
            F.count(kept).alias("valid_count"),
            F.min(kept).alias("min_value"),
            F.max(kept).alias("max_value"),
            F.min(VALUE).alias("recent_min"),
            F.max(VALUE).alias("recent_max"),
        )
    )
    if step == span == 1:
        return cells.withColumn("run_no", F.col("cell").cast("int") + 1).drop("cell")
    first = F.greatest(F.floor(F.col("cell") / step).cast("int") + 1, F.lit(1))
    last = F.least(F.floor((F.col("cell") + span) / step).cast("int"), F.lit(grid.count))
    return (
        cells.filter(first <= last)
        .withColumn("run_no", F.explode(F.sequence(first, last)))
        .groupBy(TAG, "run_no")
        .agg(
            F.sum("valid_count").alias("valid_count"),
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            F.min("recent_min").alias("recent_min"),
            F.max("recent_max").alias("recent_max"),
        )
    )


def with_run_columns(
    judged: DataFrame, grid: RunGrid, lookback_minutes: int, station: str, source_table: str, rule_type: str
) -> DataFrame:
    """Add identity and window columns; measurements and status are already there."""
    end = at_minutes(grid, F.col("run_no") * grid.step_minutes)
    offset = F.expr(f"make_dt_interval(0, 0, 0, {grid.run_offset.total_seconds()})")
    return (
        judged.withColumn("station", F.lit(station))
        .withColumn("source_table", F.lit(source_table))
        .withColumn("rule_type", F.lit(rule_type))
        .withColumn("window_end", end)
        .withColumn("window_start", end - F.expr(f"INTERVAL {lookback_minutes} MINUTES"))
        .withColumn("create_ts", end + offset)
        .withColumn("run_id", run_id(F.col("station"), F.col("create_ts")))
        .drop("run_no")
    )


def to_log(judged: DataFrame) -> DataFrame:
    """Keep exactly the log columns."""
    return judged.select(MONITOR_LOG.fieldNames())
