"""Every operator applied to the benchmark tables; the names are those of the check queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugewatch.config import FreshnessRule, OutlierRule, RunGrid, StuckValueRule
from gaugewatch.functions.columns import local_text, tick, to_local
from gaugewatch.functions.evidence_sql import EvidenceTables, register_functions
from gaugewatch.functions.noise import add_noise, add_noise_keyed
from gaugewatch.operators import derived, evidence, incidents as inc, profile, report, reshape, sketches
from gaugewatch.operators.freshness import freshness
from gaugewatch.operators.outlier import fenced_percentiles, iqr_fences, outlier
from gaugewatch.operators.runs import tag_runs, window_extrema
from gaugewatch.operators.stuck import stuck_value
from gaugewatch.operators.trailing import fenced_history_percentiles, ranks_in_history
from gaugewatch.plans.monitoring import merge_arrivals, monitor_history
from gaugewatch.schemas import MONITOR_LOG, TAG, THRESHOLD_FIELDS, TS, VALUE
from gaugewatch.session import scratch_dir, stage
from gaugewatch.sources import quarantine
from gaugewatch.sources.readings import map_fields
from gaugewatch.sources.tables import incident_history, lay_out_long
from gaugewatch.sources.testdata import (
    EVENT_TAGS,
    EVENTS_END,
    EVENTS_START,
    LINEITEM_TAGS,
    events_long,
    events_wide,
    lineitem_wide,
    table,
)
from gaugewatch.streaming.late import LateRows
from gaugewatch.streaming.monitors import StagedIncidents, WindowParts, incident_stream, session_approximation
from gaugewatch.streaming.state import OutlierStream, closing_incidents

STATION, SOURCE = "demo station", "events"
GRID = RunGrid.hourly(EVENTS_START, EVENTS_END)
STUCK = StuckValueRule(60, 3, 40.0, ("purchase", "view"))
STUCK_LONG = StuckValueRule(180, 5, 60.0, ())
OUTLIER = OutlierRule(60, 7, 1.5)
FANOUT = 64

RUN_AT = datetime(2024, 1, 20, 12, 30, 45)
AS_OF = datetime(2024, 1, 31, 0, 10)
WINDOW = (datetime(2024, 1, 10), datetime(2024, 1, 12, 6))
PHASES = (datetime(2024, 1, 9), datetime(2024, 1, 10), datetime(2024, 1, 11), datetime(2024, 1, 12))
EVENT_PERIODS = {
    "baseline": (datetime(2024, 1, 1), datetime(2024, 1, 31)),
    "recent": (datetime(2024, 1, 21), datetime(2024, 1, 31)),
}
LINEITEM_PERIODS = {
    "baseline": (datetime(1995, 1, 1), datetime(2001, 12, 31)),
    "recent": (datetime(2001, 1, 1), datetime(2001, 12, 31)),
}
SPLIT_AT = datetime(2024, 1, 16)
REQUESTED = [" CLICK", "sign-up", "View ", "view", "signup", "nothing"]
WORN = ["click", "error", "view"]


def shown(df: DataFrame, digits: int = 8) -> DataFrame:
    """Plain UTC times, rounded reals and one width of integers, for comparison with another engine."""
    columns = []
    for field in df.schema.fields:
        column = tick(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            column = F.round(column.cast("double"), digits)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# ---- the stored tables the incident views read: made once per session and data set -------------

_stored: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = stage(make())
    return _stored[key]


def build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly backfill of both rules over the whole history."""
    return monitor_history(
        events_long(spark, sf_dir), EVENT_TAGS, EVENT_TAGS, GRID, STUCK, OUTLIER, STATION, SOURCE, fanout=FANOUT
    )


def monitor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "log", lambda: build_log(spark, sf_dir))


def incident_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "incidents", lambda: inc.merge_incidents(monitor_log(spark, sf_dir)))


def feedback_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments on about half of the incidents, chosen by their identifier."""
    first = F.substring("incident_id", 1, 1)
    notes = F.when(first < "4", 2).when(first < "8", 1).otherwise(0)
    return (
        incident_table(spark, sf_dir)
        .filter(notes > 0)
        .withColumn("i", F.explode(F.sequence(F.lit(1), notes)))
        .select(
            "incident_id",
            F.concat(F.lit("note "), F.col("i").cast("string")).alias("comment"),
            F.lit("analyst").alias("created_by"),
            (F.col("update_ts") + F.col("i") * F.expr("INTERVAL 1 DAY")).alias("create_ts"),
        )
    )


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.match_logs(incident_table(spark, sf_dir), monitor_log(spark, sf_dir))


# ---- wide and long forms -------------------------------------------------------------------------


def q_wide_to_long(spark, sf_dir):
    return shown(reshape.wide_to_long(events_wide(spark, sf_dir), EVENT_TAGS))


def q_long_table_summary(spark, sf_dir):
    return shown(evidence.table_summary(reshape.wide_to_long(lineitem_wide(spark, sf_dir), LINEITEM_TAGS)))


def q_tag_summary(spark, sf_dir):
    return shown(evidence.tag_summary(events_long(spark, sf_dir), WORN))


def q_history_slice(spark, sf_dir):
    return shown(reshape.history_slice(lineitem_wide(spark, sf_dir), datetime(1996, 1, 1), datetime(1996, 7, 1)))


def q_tag_history(spark, sf_dir):
    wide = lineitem_wide(spark, sf_dir)
    return shown(
        reshape.tag_history(
            wide, ["l_quantity", "l_tax"], datetime(1997, 3, 1), datetime(1997, 4, 1), known=LINEITEM_TAGS
        )
    )


def q_incident_history(spark, sf_dir):
    return shown(incident_history(events_wide(spark, sf_dir), "click", datetime(2024, 1, 10), datetime(2024, 1, 14)))


def q_comparison_long(spark, sf_dir):
    return shown(reshape.comparison_long(events_wide(spark, sf_dir), EVENT_TAGS[1:], known=EVENT_TAGS))


def q_comparison_xy(spark, sf_dir):
    wide = lineitem_wide(spark, sf_dir)
    return shown(reshape.comparison_xy(wide, ["l_quantity", "l_extendedprice"], "l_discount", known=LINEITEM_TAGS))


def q_layout_long_table(spark, sf_dir):
    """Rows and times per tag after laying the table out anew: nothing may be lost."""
    laid = lay_out_long(events_long(spark, sf_dir), 8)
    return laid.groupBy(TAG).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(TS).alias("times"))


def q_map_fields(spark, sf_dir):
    """Feed-like text rows from events: odd values, offsets, bad times."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", "No Data").otherwise(value).alias("Net Power"),
        F.when(kind == "click", value).alias("Vacuum Pump 40  Current"),
        value.alias("LP_STEAM_PRESSURE_2"),
        F.when(F.col("event_id") % 7 == 0, F.lit("not a time"))
        .when(F.col("event_id") % 7 == 1, F.concat(stamp, F.lit("9+12:00")))
        .otherwise(F.concat(stamp, F.lit("9Z")))
        .alias("Timestamp"),
    )
    mapped = map_fields(raw)
    return shown(mapped.select(TS, "Net_Power", "Vacuum_Pump_40_Current", "LP_STEAM_PRESSURE_2", "Humidity"))


FEED = {"Event Number": "event_id", "Net Power": "Net_Power", "Lp Demister Steam Pressure": "LP_STEAM_PRESSURE_2"}


def _feed_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines from events, some of them cut off, without time, or with text for numbers."""
    number, value = F.col("event_id"), F.col("value").cast("string")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'9Z'")
    record = F.struct(
        number.alias("Event Number"),
        F.when(number % 5 == 0, "No Data").otherwise(value).alias("Net Power"),
        F.when(number % 3 == 0, "Bad").when(number % 3 == 1, value).alias("LP_STEAM_PRESSURE_2"),
        F.when(number % 7 == 0, "not a time").when(number % 7 != 1, stamp).alias("Timestamp"),
    )
    line = F.to_json(record)
    cut = F.when(number % 11 == 0, F.expr("substring(line, 1, length(line) - 4)")).otherwise(F.col("line"))
    folder = f"{scratch_dir(spark)}/feed-{datetime.now():%Y%m%d%H%M%S%f}"
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line")).select(cut.alias("value"))
    rows.write.text(folder)
    return folder


def q_load_json(spark, sf_dir):
    """Every record of the feed: loaded or not, its values, and what was wrong with it."""
    feed = quarantine.read_feed(spark.read, _feed_lines(spark, sf_dir), FEED, lines=True, names="*.txt")
    examined = quarantine.examine(feed, FEED)
    good = quarantine.loaded(examined).select("event_id", TS, "Net_Power", "LP_STEAM_PRESSURE_2", F.lit(True).alias("loaded"))
    # A record that is no JSON still shows its number.
    number = F.regexp_extract("record", '"Event Number":"?([0-9]+)', 1).try_cast("double").alias("event_id")
    reason = F.transform("problems", lambda p: F.concat_ws(":", F.coalesce(p["field"], F.lit("-")), p["reason"], p["found"]))
    bad = quarantine.rejects(examined).select(number, F.concat_ws(",", reason).alias("problems"), F.col("loaded").alias("kept"))
    both = good.join(bad, "event_id", "full")
    return shown(both.select(
        F.col("event_id").cast("long").alias("event_id"), TS, "Net_Power", "LP_STEAM_PRESSURE_2",
        F.coalesce("loaded", "kept").alias("loaded"), F.coalesce("problems", F.lit("")).alias("problems"),
    ))


def q_add_noise(spark, sf_dir):
    """Per tag: rows, rows with noise in bounds, and whether most rows moved."""
    return _noise_check(events_long(spark, sf_dir), lambda df: add_noise(df))


def q_add_noise_keyed(spark, sf_dir):
    """The same, and rows whose noise comes out alike in another partitioning."""
    noise = lambda df: add_noise_keyed(df, [TS, TAG])
    return _noise_check(events_long(spark, sf_dir), noise, repeats=True)


def _noise_check(long: DataFrame, noise, repeats: bool = False) -> DataFrame:
    both = noise(long.withColumn("clean", F.col(VALUE).cast("string")))
    clean = F.col("clean").cast("double")
    inside = (F.col(VALUE) >= clean) & (F.col(VALUE) <= clean * 1.02)
    moved = F.count_if(F.col(VALUE) > clean) * 2 > F.count(F.lit(1))
    checks = [F.count_if(inside).alias("rows_in_bounds"), moved.alias("mostly_moved")]
    if repeats:
        # Draw once more from the clean value; text columns are left alone.
        both = both.withColumn("first", F.col(VALUE).cast("string")).withColumn(VALUE, clean)
        both = noise(both.repartition(3, VALUE)).withColumn("alike", F.col(VALUE).cast("string") == F.col("first"))
        checks.append(F.count_if("alike").alias("rows_alike"))
    return both.groupBy(TAG).agg(F.count(F.lit(1)).alias("row_count"), *checks)


# ---- rules -----------------------------------------------------------------------------------------

_RUN = ["run_id", TAG, "window_start", "window_end", "status"]


def q_stuck_value_hourly(spark, sf_dir):
    judged = stuck_value(events_long(spark, sf_dir), EVENT_TAGS, GRID, STUCK, STATION, SOURCE)
    return shown(judged.select(*_RUN, "valid_count", "min_value", "max_value", "range_value"))


def q_stuck_value_overlapping(spark, sf_dir):
    judged = stuck_value(events_long(spark, sf_dir), EVENT_TAGS, GRID, STUCK_LONG, STATION, SOURCE)
    return shown(judged.select(*_RUN, "valid_count", "min_value", "max_value", "range_value"))


def q_stuck_value_single(spark, sf_dir):
    grid = RunGrid.single(RUN_AT)
    judged = stuck_value(
        events_long(spark, sf_dir), [*EVENT_TAGS, "absent"], grid, STUCK_LONG, STATION, SOURCE
    )
    return shown(judged.select(*_RUN, "valid_count", "min_value", "max_value", "range_value", "create_ts"))


def q_recent_extrema(spark, sf_dir):
    found = window_extrema(events_long(spark, sf_dir), GRID, OUTLIER.lookback_minutes)
    return shown(found.filter(F.col("run_no").between(1, GRID.count)).select(TAG, "run_no", "recent_min", "recent_max"))


def q_iqr_fences(spark, sf_dir):
    return shown(iqr_fences(events_long(spark, sf_dir)))


def q_fenced_p1_p99(spark, sf_dir):
    long = events_long(spark, sf_dir)
    return shown(fenced_percentiles(long, stage(iqr_fences(long))))


def q_trailing_percentiles(spark, sf_dir):
    tags = tag_runs(spark, EVENT_TAGS, GRID)
    return shown(
        fenced_history_percentiles(
            events_long(spark, sf_dir), tags, GRID, OUTLIER.lookback_minutes, timedelta(days=14), FANOUT
        )
    )


SKETCHED_DAYS = 14


def q_trailing_sketch(spark, sf_dir):
    """Percentiles from hourly sketches: the counts, and whether each has a rank within the stated error.

    The ranks of the sketches' answers are counted exactly in the readings.
    """
    long, history = events_long(spark, sf_dir), timedelta(days=SKETCHED_DAYS)
    cells = stage(sketches.sketch_cells(long, GRID, 60))
    runs = tag_runs(spark, EVENT_TAGS, GRID)
    found = stage(sketches.trailing_sketch_percentiles(cells, runs, GRID, OUTLIER.lookback_minutes, history))
    names = ["history_q1", "history_q3", "history_p1", "history_p99", "lower_fence", "upper_fence"]
    asked = found.select(TAG, "run_no", F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.col(n).alias("bound")) for n in names])).alias("a"))
    ranked = ranks_in_history(
        long, asked.select(TAG, "run_no", "a.target", "a.bound"), GRID, OUTLIER.lookback_minutes, history, FANOUT
    )
    at = lambda name, side: F.max(F.when(F.col("target") == name, F.col(side)))
    sides = [at(n, side).alias(f"{n}_{side}") for n in names for side in ("n_below", "n_upto")]
    both = found.join(ranked.groupBy(TAG, "run_no").agg(*sides), [TAG, "run_no"])
    n, error, tail = F.col("history_count"), sketches.rank_error(), sketches.tail_error()

    def within(name, wanted, allowed):
        slack = allowed * n + 1
        return (F.col(f"{name}_n_below") - slack <= wanted) & (F.col(f"{name}_n_upto") + slack >= wanted)

    under, upto = F.col("lower_fence_n_below"), F.col("upper_fence_n_upto")
    return shown(
        both.select(
            TAG,
            "run_no",
            "history_count",
            within("history_q1", 0.25 * n, error).alias("q1_within"),
            within("history_q3", 0.75 * n, error).alias("q3_within"),
            within("history_p1", under + 0.01 * (upto - under), tail).alias("p1_within"),
            within("history_p99", under + 0.99 * (upto - under), tail).alias("p99_within"),
        )
    )


_LIMITS = ["recent_min", "recent_max", "history_p1", "history_p99", "lower_threshold", "upper_threshold"]


def q_outlier_hourly(spark, sf_dir):
    judged = outlier(events_long(spark, sf_dir), EVENT_TAGS, GRID, OUTLIER, STATION, SOURCE, fanout=FANOUT)
    return shown(judged.select(*_RUN, *_LIMITS))


def q_outlier_single(spark, sf_dir):
    judged = outlier(
        events_long(spark, sf_dir), [*EVENT_TAGS, "absent"], RunGrid.single(RUN_AT),
        OutlierRule(30, 14, 1.5), STATION, SOURCE,
    )
    return shown(judged.select(*_RUN, *_LIMITS, "create_ts"))


def q_freshness(spark, sf_dir):
    long = events_long(spark, sf_dir)
    judged = [
        freshness(rows, FreshnessRule(30), RUN_AT, STATION, name, AS_OF).drop("observed_value")
        for name, rows in [("events", long), ("errors", long.filter(F.col(TAG) == "error"))]
    ]
    # A table without rows is always stale.
    none = freshness(long.filter(F.col(TAG) == "absent"), FreshnessRule(30), RUN_AT, STATION, "empty", AS_OF)
    return shown(judged[0].unionByName(judged[1]).unionByName(none.drop("observed_value")))


def q_monitoring_backfill(spark, sf_dir):
    """The flagship: both rules over every run, merged into incidents."""
    return shown(inc.merge_incidents(stage(build_log(spark, sf_dir))))


def q_observed_values(spark, sf_dir):
    """What the log's JSON says, read back field by field."""
    read = lambda name, kind: F.get_json_object("observed_value", f"$.{name}").cast(kind).alias(name)
    fields = [read("valid_count", "long"), *[read(n, "double") for n in ("min_value", "max_value", "range")]]
    log = monitor_log(spark, sf_dir)
    return shown(log.select("run_id", TAG, "rule_type", *fields, *[read(n, "double") for n in THRESHOLD_FIELDS])
                 .withColumn("valid_count", F.col("valid_count").cast("double")))


def q_monitor_log(spark, sf_dir):
    return shown(monitor_log(spark, sf_dir).drop("observed_value"))


# ---- incidents -------------------------------------------------------------------------------------


def q_incident_groups(spark, sf_dir):
    return shown(inc.group_failures(inc.failed_since(monitor_log(spark, sf_dir)), 3 * 3600).drop("incident_id"))


def q_incident_merge(spark, sf_dir):
    return shown(inc.merge_incidents(monitor_log(spark, sf_dir)))


def q_incident_merge_increment(spark, sf_dir):
    """In two increments; the second extends what the first left open."""
    log = monitor_log(spark, sf_dir)
    first = stage(inc.merge_incidents(log.filter(F.col("create_ts") < F.lit(str(SPLIT_AT)).cast("timestamp"))))
    return shown(inc.merge_incidents(log, first))


def q_late_rows(spark, sf_dir):
    """Failures that arrive after the incidents of a later time were stored."""
    log = monitor_log(spark, sf_dir)
    stored = stage(inc.merge_incidents(log.filter(F.col("create_ts") >= F.lit(str(SPLIT_AT)).cast("timestamp"))))
    return shown(inc.late_rows(log, stored).drop("observed_value"))


def q_incident_merge_late(spark, sf_dir):
    """The later half is stored first; merging brings in the earlier half, which arrives late."""
    log = monitor_log(spark, sf_dir)
    stored = stage(inc.merge_incidents(log.filter(F.col("create_ts") >= F.lit(str(SPLIT_AT)).cast("timestamp"))))
    return shown(merge_arrivals(log, stored).drop("incident_id"))


def q_recent_incidents(spark, sf_dir):
    rows = inc.recent_incidents(
        incident_table(spark, sf_dir), monitor_log(spark, sf_dir), feedback_table(spark, sf_dir), SOURCE
    )
    labelled = inc.with_display_labels(rows, "Station A").drop("observed_value")
    # As a real number, so that a missing count reads the same everywhere.
    return shown(labelled.withColumn("feedback_count", F.col("feedback_count").cast("double")))


def q_incident_summary(spark, sf_dir):
    return shown(inc.incident_summary(_recent(spark, sf_dir)))


def _recent(spark, sf_dir):
    return inc.recent_incidents(
        incident_table(spark, sf_dir), monitor_log(spark, sf_dir), feedback_table(spark, sf_dir), ordered=False
    )


def q_incident_metrics(spark, sf_dir):
    return inc.incident_metrics(inc.incident_summary(_recent(spark, sf_dir), ordered=False))


def q_feedback_counts(spark, sf_dir):
    return shown(inc.feedback_counts(feedback_table(spark, sf_dir)))


def q_session_approximation(spark, sf_dir):
    return shown(session_approximation(monitor_log(spark, sf_dir), 3600))


# ---- profiles --------------------------------------------------------------------------------------


def _lineitem_readings(spark, sf_dir):
    return reshape.readings_with_nulls(lineitem_wide(spark, sf_dir), LINEITEM_TAGS)


def _event_readings(spark, sf_dir):
    return reshape.readings_with_nulls(events_wide(spark, sf_dir), EVENT_TAGS)


def q_profile_stats(spark, sf_dir):
    readings = _lineitem_readings(spark, sf_dir)
    tags = [*LINEITEM_TAGS, "absent"]
    return shown(profile.profile_stats(readings, LINEITEM_PERIODS, tags), 7)


def q_profile_stats_with_nulls(spark, sf_dir):
    return shown(profile.profile_stats(_event_readings(spark, sf_dir), EVENT_PERIODS, EVENT_TAGS))


def _trend(spark, sf_dir):
    return profile.daily_trend(_event_readings(spark, sf_dir), EVENT_PERIODS["baseline"])


def q_daily_trend(spark, sf_dir):
    return shown(_trend(spark, sf_dir))


def q_gap_stats(spark, sf_dir):
    return shown(profile.gap_stats(_event_readings(spark, sf_dir), EVENT_PERIODS["baseline"]))


def q_percentile_shift(spark, sf_dir):
    stats = profile.profile_stats(_event_readings(spark, sf_dir), EVENT_PERIODS, EVENT_TAGS)
    return shown(profile.percentile_shift(stats))


def q_drift_long(spark, sf_dir):
    stats = profile.profile_stats(_event_readings(spark, sf_dir), EVENT_PERIODS, EVENT_TAGS)
    return shown(profile.drift_long(stats))


def q_trend_summary(spark, sf_dir):
    return shown(
        profile.trend_summary(_trend(spark, sf_dir))
        .withColumn("latest_date", F.col("latest_day.profile_date"))
        .withColumn("latest_p50", F.col("latest_day.p50"))
        .drop("latest_day")
    )


def q_availability_long(spark, sf_dir):
    return shown(profile.availability_long(_trend(spark, sf_dir)))


def q_trend_long(spark, sf_dir):
    return shown(profile.trend_long(_trend(spark, sf_dir)))


def q_histogram_fixed(spark, sf_dir):
    return shown(profile.fixed_histogram(_event_readings(spark, sf_dir), EVENT_PERIODS["baseline"]))


def q_density(spark, sf_dir):
    histogram = profile.fixed_histogram(_event_readings(spark, sf_dir), EVENT_PERIODS["baseline"])
    return shown(profile.density(histogram))


def q_histogram_adaptive(spark, sf_dir):
    return profile.adaptive_histogram(_event_readings(spark, sf_dir), EVENT_PERIODS["baseline"])


def q_histogram_adaptive_totals(spark, sf_dir):
    """What must hold for any adaptive histogram: 40 bins that add up to the values."""
    return (
        q_histogram_adaptive(spark, sf_dir)
        .groupBy(TAG)
        .agg(F.count(F.lit(1)).alias("bin_count"), F.sum("value_count").alias("total_count"))
    )


def q_density_summary(spark, sf_dir):
    histogram = profile.fixed_histogram(_event_readings(spark, sf_dir), EVENT_PERIODS["baseline"])
    summary = profile.density_summary(histogram)
    return shown(
        summary.select(
            TAG, "bin_count", "total_count",
            F.get("top_bins", F.lit(0))["bin_center"].alias("fullest_bin"),
            F.get("top_bins", F.lit(4))["value_count"].alias("fifth_count"),
        )
    )


def q_tag_profile(spark, sf_dir):
    """Rows of each data set of the profile."""
    parts = profile.tag_profile(
        _event_readings(spark, sf_dir), EVENT_TAGS, EVENT_PERIODS["baseline"], EVENT_PERIODS["recent"]
    )
    sizes = [df.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("part"), "row_count")
             for name, df in parts.items()]
    return sizes[0].union(sizes[1]).union(sizes[2]).union(sizes[3])


def _profile_report(spark, sf_dir):
    return profile.tag_profile_report(
        _event_readings(spark, sf_dir), EVENT_TAGS, reshape.catalog_frame(spark, EVENT_TAGS),
        EVENT_PERIODS["baseline"], EVENT_PERIODS["recent"], histogram=profile.fixed_histogram,
    )


def q_tag_profile_report(spark, sf_dir):
    return shown(
        _profile_report(spark, sf_dir).select(
            TAG,
            F.col("stats.baseline.row_count").alias("baseline_rows"),
            F.col("stats.recent.non_null_count").alias("recent_values"),
            F.col("stats.recent.p50").alias("recent_p50"),
            F.col("percentile_shift.p99").alias("p99_shift"),
            F.col("density_distribution.bin_count").alias("bin_count"),
            F.col("daily_trend.day_count").alias("day_count"),
            F.col("daily_trend.max_p99").alias("max_p99"),
            F.col("gap_profile.large_gap_count").alias("large_gap_count"),
            F.get_json_object("report", "$.windows.recent_start_nzt").alias("recent_start_nzt"),
        )
    )


# ---- evidence --------------------------------------------------------------------------------------


def q_tag_catalog(spark, sf_dir):
    return shown(evidence.tag_catalog(events_long(spark, sf_dir)).withColumn("tags", F.array_join("tags", ",")))


def q_raw_points_sample(spark, sf_dir):
    return shown(evidence.raw_points_sample(events_long(spark, sf_dir), WORN, *WINDOW))


def q_window_stats(spark, sf_dir):
    return shown(evidence.window_stats(events_long(spark, sf_dir), WORN, *WINDOW))


def q_phase_stats(spark, sf_dir):
    return shown(evidence.phase_stats(events_long(spark, sf_dir), WORN, *PHASES))


def q_gap_profile(spark, sf_dir):
    return shown(evidence.gap_profile(events_long(spark, sf_dir), WORN, *WINDOW))


def q_match_tag_names(spark, sf_dir):
    return shown(evidence.match_tag_names(events_long(spark, sf_dir), REQUESTED))


def q_threshold_context(spark, sf_dir):
    return shown(evidence.threshold_context(events_long(spark, sf_dir), REQUESTED, *WINDOW, 10.0, 120.0))


def q_incident_packet(spark, sf_dir):
    return shown(
        evidence.incident_packet_summary(
            incident_table(spark, sf_dir), monitor_log(spark, sf_dir), feedback_table(spark, sf_dir)
        )
    )


def q_incident_phase_stats(spark, sf_dir):
    return shown(evidence.incident_phase_stats(events_long(spark, sf_dir), incident_table(spark, sf_dir)))


def q_evidence_functions(spark, sf_dir):
    """The SQL functions over the whole history; one figure out of each JSON answer."""
    register_demo_functions(spark, sf_dir)
    window = f"array('click', 'view'), timestamp'{EVENTS_START}', timestamp'{EVENTS_END}'"
    phases = ", ".join(f"timestamp'{at}'" for at in PHASES)
    calls = {
        "get_app_tag_catalog": ("", "$.tag_count"),
        "get_incident_packet": ("(SELECT min(incident_id) FROM demo_incident)", "$.quality_log_rows[0].run_id"),
        "get_raw_points_sample": (window, "$.returned_points"),
        "get_related_tag_window_stats": (window, "$.stats[0].p75_value"),
        "get_before_during_after_stats": (f"array('click', 'view'), {phases}", "$.stats[0].point_count"),
        "get_missingness_gap_profile": (window, "$.stats[1].max_gap_seconds"),
        "get_outlier_threshold_context": (f"{window}, 10D, 120D", "$.stats[0].above_upper_threshold_count"),
    }
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{path}' AS path, {name}({args}) AS answer" for name, (args, path) in calls.items()
    )
    return spark.sql(rows).select(
        "name",
        F.get_json_object("answer", "$.status").alias("status"),
        F.expr("get_json_object(answer, path)").alias("figure"),
    )


def register_demo_functions(spark, sf_dir) -> None:
    tables = EvidenceTables("demo_long", "demo_incident", "demo_log", "demo_feedback")
    events_long(spark, sf_dir).createOrReplaceTempView(tables.long)
    incident_table(spark, sf_dir).createOrReplaceTempView(tables.incidents)
    monitor_log(spark, sf_dir).createOrReplaceTempView(tables.log)
    feedback_table(spark, sf_dir).createOrReplaceTempView(tables.feedback)
    register_functions(spark, tables)


# ---- reports ---------------------------------------------------------------------------------------


def q_threshold_windows(spark, sf_dir):
    return shown(report.threshold_windows(_matched(spark, sf_dir)))


def q_trigger_summary(spark, sf_dir):
    limits = report.latest_thresholds(report.threshold_windows(_matched(spark, sf_dir)))
    triggers = report.trigger_summary(limits)
    return shown(triggers.withColumn("breached_thresholds", F.array_join("breached_thresholds", ",")))


def q_raw_context(spark, sf_dir):
    return shown(report.raw_context(events_long(spark, sf_dir), incident_table(spark, sf_dir)))


def q_first_logs(spark, sf_dir):
    return shown(report.first_logs(_matched(spark, sf_dir), 2).drop("observed_value"))


def q_incident_report(spark, sf_dir):
    made = report.incident_report(incident_table(spark, sf_dir), monitor_log(spark, sf_dir), events_long(spark, sf_dir))
    return shown(
        made.select(
            "incident_id",
            F.get_json_object("report", "$.incident.incident_start_nzt").alias("incident_start_nzt"),
            F.col("outlier_trigger.status").alias("trigger_status"),
            F.col("evidence_request.status").alias("request_status"),
            "threshold_window_count",
            F.size("quality_log_rows").alias("log_rows"),
            F.col("raw_context.row_count").alias("context_rows"),
            F.col("raw_context.latest_value").alias("latest_value"),
        )
    )


def q_local_time(spark, sf_dir):
    """Readings per local day and the first local time of each, one year of shipments across clock changes."""
    wide = reshape.history_slice(lineitem_wide(spark, sf_dir), datetime(1996, 1, 1), datetime(1997, 1, 1))
    return shown(
        wide.groupBy(F.date_trunc("DAY", to_local(F.col(TS))).alias("local_day")).agg(
            F.count(F.lit(1)).alias("row_count"), F.min(local_text(F.col(TS))).alias("first_local")
        )
    )


# ---- derived measures ----------------------------------------------------------------------------


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under the names of flow and pressure tags."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("HP_STEAM_FLOW_ALL"),
        (F.col("l_tax") * 100).alias("HP_GES_STEAM_SUPPLY"),
        (F.col("l_discount") * 300).alias("HP_BRINE_FLOW"),
        (F.col("l_extendedprice") / 100).alias("BRINE_FLOW_TO_REINJECTION"),
        (F.col("l_quantity") * 2).alias("LP_STEAM_FLOW"),
        (F.col("l_quantity") * 3).alias("Total_Turbine_Steam_Flow"),
        (F.col("l_quantity") / 5).alias("Turbine_Hp_Chamber_Pressure"),
        (F.col("l_discount") * 50 + 1).alias("Turbine_Lp_Chamber_Pressure"),
        (F.col("l_tax") + 0.05).alias("Condenser_Pressure_A"),
    )


def q_derived_tags(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    made = derived.derived_tags(flows)
    return shown(made.select("l_orderkey", "l_linenumber", *derived.DERIVED), 6)


def q_cross_check(spark, sf_dir):
    made = derived.cross_check(_flows(spark, sf_dir), wells=("HP_BRINE_FLOW", "LP_STEAM_FLOW"), least_flow=10.0)
    return shown(made.select("l_orderkey", "l_linenumber", *derived.TWO_PHASE, "spread", "relative_spread"), 6)


# ---- streams ---------------------------------------------------------------------------------------


def q_stream_stuck_value(spark, sf_dir):
    """Readings arrive as a file stream; every window is there in the end, the last of each tag too."""
    table(spark, sf_dir, "events")
    readings = (
        spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select(F.col("ts").cast("timestamp").alias(TS), F.col("event_type").alias(TAG), F.col("value").alias(VALUE))
    )
    base = _stream_folder(spark)
    parts = WindowParts(spark, f"{base}/parts", STUCK)
    _run_stream(parts.writer(readings), base)
    return shown(parts.read())


def _arriving(spark: SparkSession, rows: DataFrame, base: str, by, files: int = 3) -> DataFrame:
    """The rows as a file stream, one file a batch, each a range of ``by``."""
    rows.repartitionByRange(files, by).write.parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def _stream_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/stream-{datetime.now():%Y%m%d%H%M%S%f}"


def _run_stream(writer, base: str) -> None:
    query = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def q_stream_stuck_hourly(spark, sf_dir):
    """Readings arrive in files; every run of the grid is judged from the parts, skipped ones too."""
    base = _stream_folder(spark)
    parts = WindowParts(spark, base, STUCK)
    _run_stream(parts.writer(_arriving(spark, events_long(spark, sf_dir), base, TS)), base)
    parts.fold(1)
    judged = parts.judge(EVENT_TAGS, GRID, STATION, SOURCE)
    return shown(judged.select(*_RUN, "valid_count", "min_value", "max_value", "range_value"))


LATE_DELAY = timedelta(days=5)
ARRIVALS = (datetime(2024, 1, 11), datetime(2024, 1, 21))


def q_late_readings(spark, sf_dir):
    """Readings come in three batches, some with the last one: those whose window was closed by then."""
    base = _stream_folder(spark)
    parts = WindowParts(spark, f"{base}/parts", STUCK)
    late = LateRows(spark, base, 60, LATE_DELAY, parts.keep)
    events = table(spark, sf_dir, "events").withColumn("moment", F.col("ts").cast("timestamp"))
    batch = F.when(F.col("event_id") % 50 == 7, 2).when(F.col("moment") < ARRIVALS[0], 0).when(F.col("moment") < ARRIVALS[1], 1)
    rows = events.select(
        F.col("moment").alias(TS), F.col("event_type").alias(TAG), F.col("value").alias(VALUE),
        F.coalesce(batch, F.lit(2)).alias("batch"),
    )
    for number in range(3):
        late.keep(rows.where(F.col("batch") == number).drop("batch"), number)
    totals = late.counts().select("batch", "arrived", "late")
    return shown(late.read().join(totals, "batch").select("batch", TS, TAG, VALUE, "watermark", "arrived", "late"))


def q_stream_outlier(spark, sf_dir):
    """The outlier rule on a stream of files, against the history that the stream has stored."""
    base = _stream_folder(spark)
    stream = OutlierStream(spark, base, EVENT_TAGS, GRID, OUTLIER, STATION, SOURCE, fanout=FANOUT)
    _run_stream(stream.writer(_arriving(spark, events_long(spark, sf_dir), base, TS)), base)
    stream.finish()
    return shown(stream.read().select(*_RUN, *_LIMITS))


def q_stream_closing_incidents(spark, sf_dir):
    """Incidents that a timer closes. A row that passed, far behind the end, moves the watermark past the last one."""
    base = _stream_folder(spark)
    log = monitor_log(spark, sf_dir)
    last = {"status": "pass", "window_start": EVENTS_END + timedelta(days=90)}
    far = spark.createDataFrame([tuple(last.get(name) for name in MONITOR_LOG.fieldNames())], MONITOR_LOG)
    found = closing_incidents(_arriving(spark, log.unionByName(far), base, F.col("window_start")), "40 days")
    writer = found.writeStream.format("parquet").option("path", f"{base}/out")
    _run_stream(writer, base)
    return shown(spark.read.schema(found.schema).parquet(f"{base}/out"))


def q_stream_incidents(spark, sf_dir):
    """The log arrives in time slices; each micro-batch is merged into the stored incidents."""
    base = f"{scratch_dir(spark)}/stream-{datetime.now():%Y%m%d%H%M%S%f}"
    # Ten days per file, so that the stream takes several batches.
    part = F.floor(F.datediff("create_ts", F.lit("2024-01-01")) / 10).cast("int")
    monitor_log(spark, sf_dir).repartitionByRange(3, part).write.parquet(f"{base}/log")
    arriving = spark.readStream.schema(MONITOR_LOG).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    state = StagedIncidents(spark)
    query = (
        incident_stream(arriving, state.read, state.replace)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return shown(state.read().drop("incident_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name.removeprefix("q_"): run for name, run in list(globals().items()) if name.startswith("q_")
}
