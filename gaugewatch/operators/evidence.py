"""Evidence about a tag or an incident, as typed rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gaugewatch.functions.columns import half_open, local_text, tag_key, ts_lit, window_phase
from gaugewatch.operators.incidents import match_logs
from gaugewatch.operators.ranks import group_quantiles, join_on
from gaugewatch.operators.segments import gap_totals
from gaugewatch.schemas import TAG, TS, VALUE
from gaugewatch.session import local_frame, stage

MAX_SAMPLE_POINTS = 200
_REQUEST = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("requested_tag", T.StringType())])


def _window(long: DataFrame, tags: list[str], start: datetime, end: datetime) -> DataFrame:
    return long.filter(F.col(TAG).isin(*tags) & half_open(F.col(TS), start, end))


def _extent() -> list[Column]:
    return [F.count(F.lit(1)).alias("point_count"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts")]


def tag_catalog(long: DataFrame) -> DataFrame:
    """How many tags there are, which, and over what time.

    Readings are reduced to one row per tag before the list is made.
    """
    per_tag = long.groupBy(TAG).agg(F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))
    return per_tag.agg(
        F.count(TAG).alias("tag_count"),
        F.array_sort(F.collect_list(TAG)).alias("tags"),
        F.min("first_ts").alias("min_ts"),
        F.max("last_ts").alias("max_ts"),
    )


def table_summary(long: DataFrame) -> DataFrame:
    per_tag = tag_summary(long)
    return per_tag.agg(
        F.sum("row_count").alias("row_count"),
        F.count(TAG).alias("tag_count"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
    )


def tag_summary(long: DataFrame, tags: list[str] | None = None) -> DataFrame:
    chosen = long if tags is None else long.filter(F.col(TAG).isin(*tags))
    return chosen.groupBy(TAG).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(TS).alias("min_ts"), F.max(TS).alias("max_ts")
    )


def raw_points_sample(
    long: DataFrame, tags: list[str], start: datetime, end: datetime, max_points: int = MAX_SAMPLE_POINTS
) -> DataFrame:
    """The first points of each tag in the window, with the tag's total.

    The rank filter is applied before the shuffle too, so only ``max_points`` rows per tag
    and input partition travel.
    """
    points = _window(long, tags, start, end)
    order = Window.partitionBy(TAG).orderBy(TS, VALUE)
    first = points.withColumn("point_rank", F.row_number().over(order)).filter(F.col("point_rank") <= max_points)
    totals = points.groupBy(TAG).agg(F.count(F.lit(1)).alias("total_points"))
    return first.join(totals, TAG).select(TAG, TS, VALUE, "point_rank", "total_points")


QUARTILES = {"p25_value": 0.25, "median_value": 0.5, "p75_value": 0.75}


def window_stats(
    long: DataFrame, tags: list[str], start: datetime, end: datetime, accuracy: int | None = None
) -> DataFrame:
    """Extent, moments and quartiles of each tag in the window; quartiles are exact unless an ``accuracy`` is given."""
    points = _window(long, tags, start, end)
    stats = stage(
        points.groupBy(TAG).agg(
            *_extent(),
            F.min(VALUE).alias("min_value"),
            F.avg(VALUE).alias("avg_value"),
            F.max(VALUE).alias("max_value"),
            F.stddev_samp(VALUE).alias("stddev_value"),
        )
    )
    quartiles = group_quantiles(points, [TAG], QUARTILES, VALUE, accuracy)
    return join_on(stats, quartiles, [TAG], "left").select(
        TAG,
        "point_count",
        "first_ts",
        "last_ts",
        "min_value",
        "p25_value",
        "avg_value",
        "median_value",
        "p75_value",
        "max_value",
        "stddev_value",
    )


def _phase_aggregates(points: DataFrame, *keys: str) -> DataFrame:
    return (
        points.filter(F.col("window_phase").isNotNull())
        .groupBy(*keys, "window_phase")
        .agg(
            *_extent(),
            F.min(VALUE).alias("min_value"),
            F.avg(VALUE).alias("avg_value"),
            F.max(VALUE).alias("max_value"),
            F.stddev_samp(VALUE).alias("stddev_value"),
        )
    )


def phase_stats(
    long: DataFrame, tags: list[str], before_start: datetime, start: datetime, end: datetime, after_end: datetime
) -> DataFrame:
    """Statistics before, during and after an incident."""
    bounds = [ts_lit(at) for at in (before_start, start, end, after_end)]
    points = _window(long, tags, before_start, after_end)
    return _phase_aggregates(points.withColumn("window_phase", window_phase(F.col(TS), *bounds)), TAG)


def near_incidents(long: DataFrame, incidents: DataFrame, context_seconds: int = 3600) -> DataFrame:
    """Readings of each incident's tag from ``context`` before its start to after its end (closed).

    Incidents are spread over the hours they reach into, so a reading is only compared with
    incidents of its own tag and hour. The least and greatest time of all of them are looked
    up first, so the scan of the readings skips what lies outside.
    """
    context = F.expr(f"INTERVAL {context_seconds} SECONDS")
    hour = lambda ts: F.floor(F.unix_seconds(ts) / 3600)
    reach = (
        incidents.select("incident_id", TAG, "incident_start", "incident_end")
        .withColumn("from_ts", F.col("incident_start") - context)
        .withColumn("to_ts", F.col("incident_end") + context)
        .withColumn("hour", F.explode(F.sequence(hour(F.col("from_ts")), hour(F.col("to_ts")))))
    )
    first = incidents.agg(F.min(F.col("incident_start") - context).alias("first")).scalar()
    last = incidents.agg(F.max(F.col("incident_end") + context).alias("last")).scalar()
    return (
        long.filter((F.col(TS) >= first) & (F.col(TS) <= last))
        .withColumn("hour", hour(F.col(TS)))
        .join(reach, [TAG, "hour"])
        .filter((F.col(TS) >= F.col("from_ts")) & (F.col(TS) <= F.col("to_ts")))
        .drop("hour", "from_ts", "to_ts")
    )


def incident_phase_stats(long: DataFrame, incidents: DataFrame, context_seconds: int = 3600) -> DataFrame:
    """:func:`phase_stats` of every incident's own tag at once."""
    context = F.expr(f"INTERVAL {context_seconds} SECONDS")
    start, end = F.col("incident_start"), F.col("incident_end")
    phase = window_phase(F.col(TS), start - context, start, end, end + context)
    points = near_incidents(long, incidents, context_seconds).withColumn("window_phase", phase)
    return _phase_aggregates(points, "incident_id", TAG)


def gap_profile(long: DataFrame, tags: list[str], start: datetime, end: datetime) -> DataFrame:
    """Counts of values and gaps between the times of points per tag; a single point has no gaps."""
    limits = {"gaps_over_5m": 300, "gaps_over_15m": 900}
    totals = gap_totals(_window(long, tags, start, end), [TAG], TS, limits, value=VALUE)
    return totals.select(
        TAG,
        F.col("value_count").alias("point_count"),
        "first_ts",
        "last_ts",
        F.col("gap_max").alias("max_gap_seconds"),
        F.when(F.col("gap_count") > 0, F.col("gap_sum") / F.col("gap_count")).alias("avg_gap_seconds"),
        *limits,
    )


def _requests(long: DataFrame, requested: list[str]) -> DataFrame:
    """First requested spelling per key; as long as the argument list."""
    return (
        local_frame(long.sparkSession, list(enumerate(requested)), _REQUEST)
        .withColumn("tag_key", tag_key(F.col("requested_tag")))
        .groupBy("tag_key")
        .agg(F.min_by("requested_tag", "position").alias("requested_tag"))
    )


def match_tag_names(long: DataFrame, requested: list[str]) -> DataFrame:
    """Stored tags that match the requested names whatever their spelling; the others vanish."""
    known = (
        tag_summary(long)
        .groupBy(tag_key(F.col(TAG)).alias("tag_key"))
        .agg(
            F.min(TAG).alias("matched_tag"),
            F.sum("row_count").alias("catalog_point_count"),
            F.min("min_ts").alias("catalog_min_ts"),
            F.max("max_ts").alias("catalog_max_ts"),
        )
    )
    return known.join(_requests(long, requested), "tag_key").select(
        "requested_tag", "matched_tag", "catalog_point_count", "catalog_min_ts", "catalog_max_ts"
    )


def threshold_context(
    long: DataFrame, requested: list[str], start: datetime, end: datetime, lower: float, upper: float
) -> DataFrame:
    """Extremes and counts beyond the given limits, per requested and stored tag."""
    # Readings are counted by their tag first, so names are only matched once for each tag.
    by_tag = (
        long.filter(half_open(F.col(TS), start, end))
        .groupBy(F.col(TAG).alias("matched_tag"))
        .agg(
            *_extent(),
            F.min(VALUE).alias("min_value"),
            F.avg(VALUE).alias("avg_value"),
            F.max(VALUE).alias("max_value"),
            F.count_if(F.col(VALUE) < lower).alias("below_lower_threshold_count"),
            F.count_if(F.col(VALUE) > upper).alias("above_upper_threshold_count"),
        )
        .withColumn("tag_key", tag_key(F.col("matched_tag")))
    )
    return (
        by_tag.join(_requests(long, requested), "tag_key")
        .select(
            "requested_tag",
            "matched_tag",
            "point_count",
            "first_ts",
            "last_ts",
            local_text(F.col("first_ts")).alias("first_ts_nzt"),
            local_text(F.col("last_ts")).alias("last_ts_nzt"),
            "min_value",
            "avg_value",
            "max_value",
            F.lit(float(lower)).alias("lower_threshold"),
            F.lit(float(upper)).alias("upper_threshold"),
            "below_lower_threshold_count",
            "above_upper_threshold_count",
        )
    )


def incident_packet(
    incidents: DataFrame, log: DataFrame, feedback: DataFrame, incident_id: str | None = None
) -> dict[str, DataFrame]:
    """An incident with its log rows and feedback; all incidents when none is named."""
    if incident_id is not None:
        incidents = incidents.filter(F.col("incident_id") == incident_id)
        feedback = feedback.filter(F.col("incident_id") == incident_id)
    return {
        "incident": incidents,
        "quality_log_rows": match_logs(incidents, log).select(
            "incident_id",
            "log_run_id",
            "station",
            "source_table",
            TAG,
            "rule_type",
            "window_start",
            "window_end",
            "status",
            "observed_value",
            "log_create_ts",
        ),
        "feedback_rows": feedback.join(incidents.select("incident_id"), "incident_id", "left_semi"),
    }


def incident_packet_summary(incidents: DataFrame, log: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row per incident: its fields and how much evidence there is."""
    packet = incident_packet(incidents, log, feedback)
    logs = packet["quality_log_rows"].groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("log_rows"), F.min("window_start").alias("first_window"),
        F.max("window_end").alias("last_window"),
    )
    notes = packet["feedback_rows"].groupBy("incident_id").agg(F.count(F.lit(1)).alias("feedback_rows"))
    return (
        incidents.join(logs, "incident_id", "left")
        .join(notes, "incident_id", "left")
        .fillna(0, ["log_rows", "feedback_rows"])
    )
