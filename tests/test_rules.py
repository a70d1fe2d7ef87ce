import json
from datetime import datetime, timedelta

import pytest

from gaugewatch.config import (
    DEFAULT_STATION,
    FreshnessRule,
    OutlierRule,
    RunGrid,
    StuckValueRule,
    hourly,
    station_named,
    validate_window,
    window_bounds,
)
from gaugewatch.operators.freshness import freshness
from gaugewatch.operators.outlier import judge_limits, outlier
from gaugewatch.operators.runs import to_log
from gaugewatch.operators.stuck import stuck_value
from gaugewatch.schemas import LONG, MONITOR_LOG

START = datetime(2024, 1, 1)
HOUR = RunGrid(START, 1)


def stuck(frame, tags, rule=StuckValueRule(60, 3, 0.0, ()), grid=HOUR):
    return {(r.tag_name, r.window_end): r for r in stuck_value(frame, tags, grid, rule, "st", "src").collect()}


def one(rows):
    (row,) = rows.values()
    return row


def test_stuck_counts_and_range(long_frame):
    same = [("a", m, 5.0) for m in (1, 2, 3)]
    assert one(stuck(long_frame(same), ["a"])).status == "failed"
    assert one(stuck(long_frame(same[:2]), ["a"])).status == "skipped"
    moving = [*same[:2], ("a", 3, 5.5)]
    assert one(stuck(long_frame(moving), ["a"])).status == "pass"
    # A range equal to the limit still counts as stuck.
    assert one(stuck(long_frame(moving), ["a"], StuckValueRule(60, 3, 0.5, ()))).status == "failed"


def test_stuck_without_rows_is_skipped(long_frame):
    row = one(stuck(long_frame([("b", 1, 1.0)]), ["a"]))
    assert row.status == "skipped" and row.valid_count == 0
    assert json.loads(row.observed_value) == {"valid_count": 0, "min_value": None, "max_value": None, "range": None}


def test_stuck_zero_filter_is_exact_and_case_sensitive(long_frame):
    rows = [("Pump", m, 5.0) for m in (1, 2, 3)] + [("Pump", 4, 0.0)]
    assert one(stuck(long_frame(rows), ["Pump"], StuckValueRule(60, 3, 0.0, ("Pump",)))).status == "failed"
    assert one(stuck(long_frame(rows), ["Pump"], StuckValueRule(60, 3, 0.0, ("pump",)))).status == "pass"


def test_window_is_half_open(long_frame):
    rows = [("a", 0, 1.0), ("a", 59.999, 1.0), ("a", 60, 9.0)]
    row = one(stuck(long_frame(rows), ["a"], StuckValueRule(60, 2, 0.0, ())))
    assert (row.valid_count, row.status) == (2, "failed")


@pytest.mark.parametrize("lookback,step", [(180, 60), (30, 60), (90, 60), (60, 30)])
def test_overlapping_windows(long_frame, lookback, step):
    rows = [("a", m * 7, float(m % 11)) for m in range(-30, 120)]
    grid = RunGrid(START, 9, step)
    got = stuck(long_frame(rows), ["a"], StuckValueRule(lookback, 1, 0.0, ()), grid)
    assert len(got) == 9
    for run in range(1, 10):
        end = run * step
        seen = [v for _, m, v in rows if end - lookback <= m < end]
        row = got["a", START + timedelta(minutes=end)]
        assert row.valid_count == len(seen)
        assert (row.min_value, row.max_value) == (min(seen), max(seen))


def test_grid_covers_every_tag_and_run(long_frame):
    grid = RunGrid.hourly(START, START + timedelta(days=1))
    judged = stuck_value(long_frame([("a", 5, 1.0)]), ["a", "b"], grid, StuckValueRule(60, 1, 0.0, ()), "st", "src")
    log = to_log(judged)
    assert log.schema.fieldNames() == MONITOR_LOG.fieldNames()
    assert [f.dataType for f in log.schema] == [f.dataType for f in MONITOR_LOG]
    assert log.count() == 48 == log.select("tag_name", "window_end").distinct().count()


def test_single_run_drops_seconds_of_the_window_only(long_frame):
    run_dt = datetime(2024, 1, 1, 2, 30, 45)
    row = one(stuck(long_frame([("a", 100, 1.0)]), ["a"], grid=RunGrid.single(run_dt)))
    assert (row.window_start, row.window_end) == (datetime(2024, 1, 1, 1, 30), datetime(2024, 1, 1, 2, 30))
    assert row.create_ts == run_dt and row.run_id == "st__20240101_023045"
    assert window_bounds(run_dt, 60) == (row.window_start, row.window_end)


LIMITS = "recent_min double, recent_max double, history_p1 double, history_p99 double"


@pytest.mark.parametrize(
    "measured,status",
    [
        ((0.0, 15.0, 1.0, 10.0), "failed"),
        ((0.5, 15.0, 1.0, 10.0), "pass"),
        ((0.5, 15.1, 1.0, 10.0), "failed"),
        ((0.4, 10.0, 1.0, 10.0), "failed"),
        ((None, None, 1.0, 10.0), "skipped"),
        ((1.0, 2.0, None, None), "skipped"),
        ((-30.0, -15.0, -20.0, -10.0), "pass"),
        ((-30.0, -14.0, -20.0, -10.0), "failed"),
        ((-30.1, -16.0, -20.0, -10.0), "failed"),
        ((1.0, float("nan"), 1.0, 10.0), "pass"),
    ],
)
def test_outlier_limits(spark, measured, status):
    row = judge_limits(spark.createDataFrame([measured], LIMITS), 1.5).first()
    assert row.status == status
    keys = {"recent_min", "recent_max", "history_p1", "history_p99"}
    extra = {"lower_threshold", "upper_threshold"} if status != "skipped" else set()
    if measured[1] == measured[1]:
        assert set(json.loads(row.observed_value)) == keys | extra


def test_outlier_negative_upper_limit(spark):
    row = judge_limits(spark.createDataFrame([(-30.0, -15.0, -20.0, -10.0)], LIMITS), 1.5).first()
    assert (row.lower_threshold, row.upper_threshold) == (-30.0, -15.0)


def test_outlier_ignores_history_outside_the_fences(spark, long_frame):
    history = [("a", m, float(10 + m % 3)) for m in range(0, 600)] + [("a", 10.5, 9e9), ("a", 11.5, -9e9)]
    frame = long_frame([*history, ("a", 630, 14.0)])
    run = RunGrid.single(START + timedelta(minutes=660))
    row = outlier(frame, ["a", "gone"], run, OutlierRule(60, 1, 1.5), "st", "src").orderBy("tag_name").collect()
    assert (row[0].history_p1, row[0].history_p99, row[0].status) == (10.0, 12.0, "pass")
    assert row[1].status == "skipped"


def fresh(spark, rows, as_of):
    frame = spark.createDataFrame([(ts, "a", 1.0) for ts in rows], LONG)
    return freshness(frame, FreshnessRule(30), as_of, "st", "src", as_of).first()


def test_freshness(spark):
    now = datetime(2024, 1, 1, 12, 0, 30)
    assert fresh(spark, [now - timedelta(minutes=30)], now).status == "pass"
    late = fresh(spark, [now - timedelta(minutes=30, seconds=1)], now)
    assert late.status == "failed" and late.tag_name == "_table_"
    assert late.late_in_minutes == pytest.approx(1801 / 60)
    empty = fresh(spark, [], now)
    assert empty.status == "failed"
    assert json.loads(empty.observed_value)["latest_batch_ts"] == "1900-01-01 00:00:00"
    assert (empty.window_start, empty.window_end) == (datetime(2024, 1, 1, 11, 30), datetime(2024, 1, 1, 12, 0))


def test_configuration():
    assert hourly(DEFAULT_STATION.lookup("rules", "stuck_value")).min_expected_rows == 60
    assert hourly(DEFAULT_STATION.lookup("rules", "outlier")).lookback_minutes == 60
    assert len(DEFAULT_STATION.lookup("watched", "stuck_value")) == 44
    assert len(DEFAULT_STATION.lookup("watched", "outlier")) == 45
    with pytest.raises(ValueError):
        station_named("elsewhere")
    with pytest.raises(ValueError):
        DEFAULT_STATION.lookup("watched", "freshness_lag")
    with pytest.raises(ValueError):
        RunGrid.hourly(datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 2))
    assert RunGrid.hourly(datetime(2024, 6, 1), datetime(2024, 10, 1)).count == 2928


def test_selection_checks():
    assert DEFAULT_STATION.select(["Humidity"]) == ["Humidity"]
    for bad in ([], ["Humidity"] * 5, ["nothing"]):
        with pytest.raises(ValueError):
            DEFAULT_STATION.select(bad)
    with pytest.raises(ValueError):
        DEFAULT_STATION.select(["Humidity"], 2, 2)
    assert validate_window(START, START + timedelta(days=90, hours=23)).large
    assert not validate_window(START, START + timedelta(days=30)).large
    for end in (START, START + timedelta(days=91)):
        with pytest.raises(ValueError):
            validate_window(START, end)
