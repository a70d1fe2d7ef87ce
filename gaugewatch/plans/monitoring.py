"""Monitoring jobs: hourly backfill, single runs, freshness gate, incident merge."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewatch.config import OutlierRule, RunGrid, Settings, StuckValueRule, hourly, station_named
from gaugewatch.operators.freshness import freshness
from gaugewatch.operators.incidents import failed_since, late_rows, merge_incidents
from gaugewatch.operators.outlier import outlier
from gaugewatch.operators.reshape import resolve_tags, wide_to_long
from gaugewatch.operators.runs import of_tags, to_log, window_extrema
from gaugewatch.operators.stuck import stuck_value
from gaugewatch.session import stage
from gaugewatch.sources.tables import IncidentStore, append_log, ensure_log_table


def monitor_history(
    long: DataFrame,
    stuck_tags: list[str],
    outlier_tags: list[str],
    grid: RunGrid,
    stuck_rule: StuckValueRule,
    outlier_rule: OutlierRule,
    station: str,
    source_table: str,
    **outlier_options,
) -> DataFrame:
    """Log rows of both rules for every run of the grid, as one plan.

    With equal windows the recent aggregates of both rules come from one pass.
    """
    extrema = None
    if stuck_rule.lookback_minutes == outlier_rule.lookback_minutes:
        watched = of_tags(long, dict.fromkeys([*stuck_tags, *outlier_tags]))
        extrema = stage(window_extrema(watched, grid, stuck_rule.lookback_minutes, stuck_rule.zero_filtered_tags))
    stuck = stuck_value(long, stuck_tags, grid, stuck_rule, station, source_table, extrema)
    wild = outlier(long, outlier_tags, grid, outlier_rule, station, source_table, extrema, **outlier_options)
    return to_log(wild).unionByName(to_log(stuck))


def _monitored(spark: SparkSession, settings: Settings, rule_type: str) -> tuple[DataFrame, list[str]]:
    wide = spark.table(settings.quality_source_table)
    found, _ = resolve_tags(wide.columns, station_named(settings.station).lookup("watched", rule_type))
    return wide, found


def run_backfill(spark: SparkSession, settings: Settings, **outlier_options) -> None:
    """All hourly runs of the history for both rules, then the incident merge."""
    grid = RunGrid.hourly(settings.history_start, settings.history_end)
    ensure_log_table(spark, settings.monitor_log_table)
    wide, outlier_tags = _monitored(spark, settings, "outlier")
    _, stuck_tags = _monitored(spark, settings, "stuck_value")
    long = wide_to_long(wide, list(dict.fromkeys(outlier_tags + stuck_tags)))
    log = monitor_history(
        long,
        stuck_tags,
        outlier_tags,
        grid,
        hourly(station_named(settings.station).lookup("rules", "stuck_value")),
        hourly(station_named(settings.station).lookup("rules", "outlier")),
        settings.station,
        settings.quality_source_table,
        **outlier_options,
    )
    append_log(log, settings.monitor_log_table)
    run_merge(spark, settings)


def run_single(spark: SparkSession, settings: Settings, rule_type: str, run_dt: datetime | None = None) -> None:
    """One rule at one run time, the end of the history by default."""
    ensure_log_table(spark, settings.monitor_log_table)
    grid = RunGrid.single(run_dt or settings.history_end)
    rule = station_named(settings.station).lookup("rules", rule_type)
    wide, tags = _monitored(spark, settings, rule_type)
    judge = {"stuck_value": stuck_value, "outlier": outlier}[rule_type]
    judged = judge(
        wide_to_long(wide, tags), tags, grid, rule, settings.station, settings.quality_source_table
    )
    append_log(judged, settings.monitor_log_table)


def merge_arrivals(log: DataFrame, incidents: DataFrame, with_late: bool = True) -> DataFrame:
    """The incident table after merging newer log rows, and late ones unless they are to be left out."""
    rows = failed_since(log, incidents)
    if with_late:
        rows = rows.unionByName(late_rows(log, incidents, whole=True))
    return merge_incidents(rows, incidents, only_newer=False)


def run_merge(spark: SparkSession, settings: Settings, with_late: bool = True) -> None:
    """Merge the log rows that the incident table does not know yet."""
    store = IncidentStore(spark, settings.incident_table)
    store.ensure()
    store.replace(merge_arrivals(spark.table(settings.monitor_log_table), store.read(), with_late))


def run_freshness(
    spark: SparkSession, settings: Settings, run_dt: datetime, as_of: datetime | None = None
) -> None:
    """Log the freshness of the source, then stop the job if it is stale."""
    ensure_log_table(spark, settings.monitor_log_table)
    rule = station_named(settings.station).lookup("rules", "freshness_lag")
    judged = stage(
        freshness(
            spark.table(settings.quality_source_table), rule, run_dt, settings.station,
            settings.quality_source_table, as_of,
        )
    )
    append_log(judged, settings.monitor_log_table)
    failed = [row.station for row in judged.filter(F.col("status") == "failed").select("station").distinct().collect()]
    if failed:
        raise RuntimeError(f"Freshness check failed for station(s): {', '.join(failed)}")
