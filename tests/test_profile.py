import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugewatch.operators import profile, reshape
from gaugewatch.schemas import LONG

START = datetime(2024, 9, 1)
PERIOD = (START, START + timedelta(days=40))


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(START + timedelta(minutes=10 * i), "a", None if i % 10 == 0 else float(i % 100)) for i in range(5760)]
    rows += [(START, "b", 1.0)]
    return spark.createDataFrame(rows, LONG)


def test_stats_of_every_tag_and_period(readings):
    periods = {"baseline": PERIOD, "recent": (PERIOD[1], PERIOD[1] + timedelta(days=1))}
    rows = {(r.tag_name, r.period): r for r in profile.profile_stats(readings, periods, ["a", "b", "c"]).collect()}
    assert len(rows) == 6
    full = rows["a", "baseline"]
    assert (full.row_count, full.non_null_count, full.null_count, full.null_rate) == (5760, 5184, 576, 0.1)
    values = sorted(float(i % 100) for i in range(5760) if i % 10)
    assert (full.min_value, full.max_value, full.p50) == (1.0, 99.0, values[len(values) // 2 - 1])
    empty = rows["c", "recent"]
    assert (empty.row_count, empty.null_count, empty.null_rate, empty.p50) == (0, 0, None, None)
    assert rows["b", "baseline"].stddev_value is None


def test_periods_are_closed(readings):
    edge = {"only": (START, START + timedelta(minutes=20))}
    assert profile.profile_stats(readings.filter("tag_name = 'a'"), edge).first().row_count == 3


def test_histograms_keep_every_value(readings):
    for histogram in (profile.fixed_histogram(readings, PERIOD), profile.adaptive_histogram(readings, PERIOD)):
        totals = {r.tag_name: r.n for r in histogram.groupBy("tag_name").agg(F.sum("value_count").alias("n")).collect()}
        assert totals == {"a": 5184, "b": 1}
    shares = profile.density(profile.fixed_histogram(readings, PERIOD)).groupBy("tag_name").agg(F.sum("density").alias("d"))
    assert all(r.d == pytest.approx(1) for r in shares.collect())


def test_density_of_nothing_is_zero(spark):
    bins = spark.createDataFrame([("a", 1.0, 0)], "tag_name string, bin_center double, value_count long")
    assert profile.density(bins).first().density == 0.0


def test_daily_trend_follows_the_clock_change(spark):
    """Clocks go forward on 29 September 2024, so that local day has 23 hours."""
    rows = [(datetime(2024, 9, 27) + timedelta(hours=h), "a", 1.0) for h in range(96)]
    frame = spark.createDataFrame(rows, LONG)
    days = {
        str(r.profile_date)[:10]: r.row_count
        for r in profile.daily_trend(frame, (rows[0][0], rows[-1][0])).collect()
    }
    assert (days["2024-09-28"], days["2024-09-29"], days["2024-09-30"]) == (24, 23, 24)


def test_gap_limits_are_strict(spark):
    minutes = [0, 15, 30 + 1 / 60]
    rows = [(START + timedelta(minutes=m), "a", 1.0) for m in minutes] + [(START, "b", 1.0), (START, "c", None)]
    got = {r.tag_name: r for r in profile.gap_stats(spark.createDataFrame(rows, LONG), PERIOD).collect()}
    assert (got["a"].interval_count, got["a"].large_gap_count) == (2, 1)
    assert got["a"].longest_gap_minutes == pytest.approx(901 / 60)
    assert (got["b"].interval_count, got["b"].average_gap_minutes, got["b"].longest_gap_minutes) == (0, None, None)
    assert "c" not in got


def test_shift_needs_both_periods(readings):
    periods = {"baseline": PERIOD, "recent": (START + timedelta(days=30), PERIOD[1])}
    stats = profile.profile_stats(readings, periods, ["a", "b"])
    shifts = {r.tag_name: r for r in profile.percentile_shift(stats).collect()}
    assert shifts["a"].p50_shift == 0.0 and shifts["b"].p50_shift is None
    assert profile.drift_long(stats).filter("tag_name = 'b'").count() == 3


def test_trend_forms(readings):
    trend = profile.daily_trend(readings, PERIOD)
    days = trend.filter("tag_name = 'a'").count()
    assert profile.availability_long(trend).filter("tag_name = 'a'").count() == 2 * days
    assert profile.trend_long(trend).filter("tag_name = 'a'").count() == 3 * days
    summary = profile.trend_summary(trend).filter("tag_name = 'a'").first()
    assert summary.day_count == days
    assert summary.latest_day.profile_date == trend.agg(F.max("profile_date")).first()[0]


def test_report_as_json(spark, readings):
    recent = (START + timedelta(days=30), PERIOD[1])
    made = profile.tag_profile_report(readings, ["a", "Humidity"], reshape.catalog_frame(spark), PERIOD, recent)
    rows = {r.tag_name: json.loads(r.report) for r in made.collect()}
    report = rows["a"]
    assert report["analysis_type"] == "tag_profile"
    assert report["stats"]["baseline"]["row_count"] == 5760
    assert report["windows"]["baseline_start_nzt"] == "2024-09-01 12:00 NZT"
    assert len(report["density_distribution"]["top_bins"]) == 5
    assert report["tag"]["display_name"] == "a" and rows["Humidity"]["tag"]["display_name"] == "Humidity"
    counts = [b["value_count"] for b in report["density_distribution"]["top_bins"]]
    assert counts == sorted(counts, reverse=True)


def test_profile_data_sets(readings):
    parts = profile.tag_profile(readings, ["a"], PERIOD, PERIOD)
    assert set(parts) == {"stats", "histogram", "daily_trend", "gap"}
    assert all(df.filter("tag_name <> 'a'").isEmpty() for df in parts.values())
