"""Tag profiles: statistics, quantiles, histograms, daily trend, gaps and drift.

Input is the long form with NULL values kept, so that missing readings can be counted; all
tags and periods are profiled in one pass per data set.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.config import GAP_MINUTES, HISTOGRAM_BINS
from gaugewatch.functions.columns import closed, local_text, null_rate, to_local, ts_lit
from gaugewatch.operators.ranks import group_quantiles, join_on
from gaugewatch.operators.runs import of_tags, tag_frame
from gaugewatch.operators.segments import gap_totals
from gaugewatch.schemas import TAG, TS, VALUE
from gaugewatch.session import stage

Period = tuple[datetime, datetime]
STATS_PROBS = {"p1": 0.01, "p5": 0.05, "p50": 0.50, "p95": 0.95, "p99": 0.99}
TREND_PROBS = {"p1": 0.01, "p50": 0.50, "p99": 0.99}
SHIFTED = ["p1", "p50", "p99"]
TOP_BINS = 5


def _in_period(readings: DataFrame, period: Period) -> DataFrame:
    return readings.filter(closed(F.col(TS), *period))


def _availability() -> list[Column]:
    return [F.count(F.lit(1)).alias("row_count"), F.count(VALUE).alias("non_null_count")]


def _with_quantiles(
    counted: DataFrame, readings: DataFrame, keys: list[str], probs: dict[str, float], accuracy: int | None
) -> DataFrame:
    """Staged counts of groups, with the groups' quantiles."""
    totals = counted.select(*keys, F.col("non_null_count").alias("n"))
    return join_on(counted, group_quantiles(readings, keys, probs, VALUE, accuracy, totals), keys, "left")


def _null_columns() -> list[Column]:
    rows, filled = F.col("row_count"), F.col("non_null_count")
    return [(rows - filled).alias("null_count"), null_rate(rows, filled).alias("null_rate")]


def profile_stats(
    readings: DataFrame, periods: dict[str, Period], tags: list[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """Per tag and period: counts, null rate, moments, extremes and five quantiles.

    A reading may lie in several periods. With ``tags`` given, a tag without rows in a
    period still has its row. Quantiles are exact unless an ``accuracy`` is given.
    """
    names = F.array_compact(
        F.array(*[F.when(closed(F.col(TS), *period), F.lit(name)) for name, period in periods.items()])
    )
    first = min(start for start, _ in periods.values())
    last = max(end for _, end in periods.values())
    keys = [TAG, "period"]
    placed = _in_period(readings, (first, last)).select(TAG, VALUE, F.explode(names).alias("period"))
    stats = stage(
        placed.groupBy(*keys).agg(
            *_availability(),
            F.avg(VALUE).alias("mean_value"),
            F.stddev_samp(VALUE).alias("stddev_value"),
            F.min(VALUE).alias("min_value"),
            F.max(VALUE).alias("max_value"),
        )
    )
    stats = _with_quantiles(stats, placed, keys, STATS_PROBS, accuracy)
    if tags is not None:
        expected = tag_frame(readings.sparkSession, tags).select(TAG, F.explode(F.array(*[F.lit(name) for name in periods])).alias("period"))
        stats = expected.join(stats, [TAG, "period"], "left").fillna(0, ["row_count", "non_null_count"])
    return stats.select(
        TAG,
        "period",
        "row_count",
        "non_null_count",
        *_null_columns(),
        "mean_value",
        "stddev_value",
        "min_value",
        "max_value",
        *STATS_PROBS,
    )


def adaptive_histogram(readings: DataFrame, period: Period, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Bins that follow the data; their places depend on how the data is partitioned."""
    return (
        _in_period(readings, period)
        .filter(F.col(VALUE).isNotNull())
        .groupBy(TAG)
        .agg(F.histogram_numeric(VALUE, F.lit(bins)).alias("buckets"))
        .select(TAG, F.explode("buckets").alias("b"))
        .select(TAG, F.col("b.x").cast("double").alias("bin_center"), F.col("b.y").cast("long").alias("value_count"))
    )


def fixed_histogram(readings: DataFrame, period: Period, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equally wide bins between each tag's extremes; empty bins have no row."""
    values = _in_period(readings, period).filter(F.col(VALUE).isNotNull())
    ranges = stage(values.groupBy(TAG).agg(F.min(VALUE).alias("low"), F.max(VALUE).alias("high")))
    width = F.col("high") - F.col("low")
    place = F.when(width > 0, F.least(F.floor((F.col(VALUE) - F.col("low")) / width * bins), F.lit(bins - 1)))
    return (
        values.join(ranges, TAG)
        .groupBy(TAG, "low", "high", F.coalesce(place, F.lit(0)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("value_count"))
        .select(TAG, (F.col("low") + width * (F.col("bin") + 0.5) / bins).alias("bin_center"), "value_count")
    )


def daily_trend(readings: DataFrame, period: Period, accuracy: int | None = None) -> DataFrame:
    """Per tag and local day: counts, null rate and three quantiles, exact unless an ``accuracy`` is given."""
    keys = [TAG, "profile_date"]
    days = _in_period(readings, period).select(TAG, VALUE, F.date_trunc("DAY", to_local(F.col(TS))).alias("profile_date"))
    counted = stage(days.groupBy(*keys).agg(*_availability()))
    return _with_quantiles(counted, days, keys, TREND_PROBS, accuracy).select(
        *keys, "row_count", "non_null_count", *_null_columns(), *TREND_PROBS
    )


def gap_stats(readings: DataFrame, period: Period, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Per tag: intervals between non-null points, and how many exceed the limit.

    With fewer than two points there is no interval, and no average or longest gap.
    """
    totals = gap_totals(
        _in_period(readings, period).filter(F.col(VALUE).isNotNull()), [TAG], TS, {"large": gap_minutes * 60}
    )
    some = F.col("gap_count") > 0
    return totals.select(
        TAG,
        F.col("gap_count").alias("interval_count"),
        F.when(some, F.col("large")).alias("large_gap_count"),
        F.when(some, F.col("gap_sum") / F.col("gap_count") / 60).alias("average_gap_minutes"),
        (F.col("gap_max") / 60).alias("longest_gap_minutes"),
    )


def percentile_shift(stats: DataFrame) -> DataFrame:
    """Recent minus baseline; NULL where either is missing."""
    at = lambda period, name: F.max(F.when(F.col("period") == period, F.col(name)))
    return stats.groupBy(TAG).agg(*[(at("recent", p) - at("baseline", p)).alias(f"{p}_shift") for p in SHIFTED])


def density(histogram: DataFrame) -> DataFrame:
    """Share of each bin in its tag's values."""
    total = F.sum("value_count").over(Window.partitionBy(TAG))
    return histogram.withColumn("density", F.when(total > 0, F.col("value_count") / total).otherwise(F.lit(0.0)))


def density_summary(histogram: DataFrame, top_bins: int = TOP_BINS) -> DataFrame:
    """Per tag: number of bins, total and the ``top_bins`` fullest bins."""
    order = Window.partitionBy(TAG).orderBy(F.desc("value_count"), "bin_center")
    top = F.struct("place", "bin_center", "value_count", "density")
    ranked = density(histogram).withColumn("place", F.row_number().over(order))
    return ranked.groupBy(TAG).agg(
        F.count(F.lit(1)).alias("bin_count"),
        F.sum("value_count").alias("total_count"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= top_bins, top))).alias("top_bins"),
    )


def trend_summary(trend: DataFrame) -> DataFrame:
    """Per tag: number of days, the latest day, and the range of each daily measure."""
    day = ["profile_date", "row_count", "non_null_count", "null_count", "null_rate", "p1", "p50", "p99"]
    ranges = [
        fold(name).alias(f"{prefix}_{name}")
        for name in ["p1", "p50", "p99", "null_rate"]
        for prefix, fold in [("min", F.min), ("max", F.max)]
    ]
    return trend.groupBy(TAG).agg(
        F.count(F.lit(1)).alias("day_count"),
        F.max_by(F.struct(*day), "profile_date").alias("latest_day"),
        *ranges,
    )


def availability_long(trend: DataFrame) -> DataFrame:
    """Daily non-null and null counts, one row each."""
    return trend.unpivot([TAG, "profile_date"], ["non_null_count", "null_count"], "point_type", "point_count")


def trend_long(trend: DataFrame) -> DataFrame:
    """Daily quantiles, one row each, missing ones dropped."""
    return trend.unpivot([TAG, "profile_date"], SHIFTED, "percentile", "value").dropna(subset=["value"])


def drift_long(stats: DataFrame) -> DataFrame:
    """Quantiles of both periods, one row each, missing ones dropped."""
    return stats.unpivot([TAG, "period"], SHIFTED, "percentile", "value").dropna(subset=["value"])


def tag_profile(
    readings: DataFrame, tags: list[str], baseline: Period, recent: Period, accuracy: int | None = None
) -> dict[str, DataFrame]:
    """The profile data sets of the given tags, unevaluated."""
    chosen = of_tags(readings, tags)
    return {
        "stats": profile_stats(chosen, {"baseline": baseline, "recent": recent}, tags, accuracy),
        "histogram": adaptive_histogram(chosen, baseline),
        "daily_trend": daily_trend(chosen, baseline, accuracy),
        "gap": gap_stats(chosen, baseline),
    }


def _rounded(*names: str) -> list[Column]:
    return [F.round(name, 6).alias(name) for name in names]


def tag_profile_report(
    readings: DataFrame,
    tags: list[str],
    catalog: DataFrame,
    baseline: Period,
    recent: Period,
    accuracy: int | None = None,
    histogram=adaptive_histogram,
    top_bins: int = TOP_BINS,
) -> DataFrame:
    """One row per tag: metadata, windows, statistics of both periods, drift, density, trend, gaps.

    ``report`` holds the same as JSON text. Reals are rounded to six digits.
    """
    chosen = of_tags(readings, tags)
    stats = stage(profile_stats(chosen, {"baseline": baseline, "recent": recent}, tags, accuracy))
    numbers = ["null_rate", "mean_value", "stddev_value", "min_value", "max_value", *STATS_PROBS]
    measures = F.struct("row_count", "non_null_count", "null_count", *_rounded(*numbers))
    by_period = stats.groupBy(TAG).agg(
        *[F.max(F.when(F.col("period") == p, measures)).alias(p) for p in ("baseline", "recent")]
    )
    shift = percentile_shift(stats).select(
        TAG, F.struct(*[F.round(f"{p}_shift", 6).alias(p) for p in SHIFTED]).alias("percentile_shift")
    )
    bins = density_summary(histogram(chosen, baseline), top_bins).select(
        TAG,
        F.struct(
            "bin_count",
            "total_count",
            F.transform(
                "top_bins",
                lambda b: F.struct(
                    F.round(b["bin_center"], 6).alias("bin_center"),
                    b["value_count"].alias("value_count"),
                    F.round(b["density"], 6).alias("density"),
                ),
            ).alias("top_bins"),
        ).alias("density_distribution"),
    )
    trend = trend_summary(daily_trend(chosen, baseline, accuracy))
    trend = trend.select(
        TAG,
        F.struct(
            "day_count",
            "latest_day",
            *_rounded(*[c for c in trend.columns if c.startswith(("min_", "max_"))]),
        ).alias("daily_trend"),
    )
    gaps = gap_stats(chosen, baseline).select(
        TAG,
        F.struct(
            "interval_count", "large_gap_count", *_rounded("average_gap_minutes", "longest_gap_minutes")
        ).alias("gap_profile"),
    )
    edges = {"recent_start": recent[0], "recent_end": recent[1], "baseline_start": baseline[0], "baseline_end": baseline[1]}
    windows = F.struct(*[F.concat(F.substring(local_text(ts_lit(at)), 1, 16), F.lit(" NZT")).alias(f"{name}_nzt") for name, at in edges.items()])
    tag = F.struct(
        F.col(TAG).alias("name"),
        F.coalesce("display_name", TAG).alias("display_name"),
        "unit",
        "process_area",
        "description",
    )
    parts = ["tag", "windows", "stats", "percentile_shift", "density_distribution", "daily_trend", "gap_profile"]
    return (
        tag_frame(readings.sparkSession, tags)
        .join(catalog.withColumnRenamed("name", TAG), TAG, "left")
        .join(by_period, TAG, "left")
        .join(shift, TAG, "left")
        .join(bins, TAG, "left")
        .join(trend, TAG, "left")
        .join(gaps, TAG, "left")
        .select(TAG, tag.alias("tag"), windows.alias("windows"), F.struct("baseline", "recent").alias("stats"), *parts[3:])
        .withColumn("report", F.to_json(F.struct(F.lit("tag_profile").alias("analysis_type"), *parts)))
    )
