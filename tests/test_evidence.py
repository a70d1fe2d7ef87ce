import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugewatch.functions.evidence_sql import EvidenceTables, register_functions
from gaugewatch.operators import evidence, incidents as inc, report
from gaugewatch.schemas import FEEDBACK, MONITOR_LOG

START = datetime(2024, 7, 10)
END = START + timedelta(hours=6)
TAGS = ["Fan_A", "Fan_B"]


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def long(long_frame):
    rows = [("Fan_A", m, float(m % 37)) for m in range(0, 360)]
    rows += [("Fan_B", m, float(m)) for m in (10, 15, 30, 45.0 + 1 / 60)] + [("fan-b", 20, 3.0), ("Lone", 5, 1.0)]
    return long_frame(rows, START)


@pytest.fixture(scope="module")
def store(spark, long):
    def row(start, end, tag, rule, observed, status="failed"):
        return (f"st__{at(end):%Y%m%d_%H%M%S}", "st", "src", tag, rule, at(start), at(end), status, observed, at(end))

    limits = dict(recent_min=1.0, recent_max=99.0, history_p1=2.0, history_p99=10.0, lower_threshold=1.0, upper_threshold=15.0)
    log = spark.createDataFrame(
        [
            row(60, 120, "Fan_A", "outlier", json.dumps(limits)),
            row(120, 180, "Fan_A", "outlier", json.dumps(limits | {"recent_min": 0.0})),
            row(180, 240, "Fan_A", "outlier", "not json"),
            row(0, 60, "Fan_B", "stuck_value", '{"valid_count": 3}'),
            row(0, 60, "Lone", "outlier", json.dumps(limits | {"upper_threshold": None})),
        ],
        MONITOR_LOG,
    )
    incidents = inc.merge_incidents(log)
    target = incidents.filter("tag_name = 'Fan_A'").first().incident_id
    notes = spark.createDataFrame([(target, "looked at", "me", at(500)), ("other", "no", "me", at(500))], FEEDBACK)
    tables = EvidenceTables("t_long", "t_incident", "t_log", "t_feedback")
    for frame, name in [(long, "t_long"), (incidents, "t_incident"), (log, "t_log"), (notes, "t_feedback")]:
        frame.createOrReplaceTempView(name)
    register_functions(spark, tables)
    return log, incidents, notes, target


def answer(spark, call):
    return json.loads(spark.sql(f"SELECT {call}").first()[0])


WINDOW = f"array('Fan_A', 'Fan_B'), timestamp'{START}', timestamp'{END}'"


def test_catalog(spark, long, store):
    row = evidence.tag_catalog(long).first()
    got = answer(spark, "get_app_tag_catalog()")
    assert (got["tag_count"], got["tags"]) == (row.tag_count, row.tags) == (4, ["Fan_A", "Fan_B", "Lone", "fan-b"])
    assert got["timestamp_col"] == "Pi_Timestamp" and got["min_ts_utc"] == "2024-07-10 00:00:00"


def test_sample_is_the_first_points(spark, long, store):
    rows = evidence.raw_points_sample(long, TAGS, START, END).collect()
    got = answer(spark, f"get_raw_points_sample({WINDOW})")
    assert got["returned_points"] == len(rows) == 204
    assert got["total_points_by_tag"][0] == {"tag_name": "Fan_A", "total_points": 360}
    assert got["max_points_per_tag"] == 200
    assert max(p["ts_utc"] for p in got["points"] if p["tag_name"] == "Fan_A") == "2024-07-10 03:19:00"


def test_window_stats(spark, long, store):
    rows = {r.tag_name: r for r in evidence.window_stats(long, TAGS, START, END).collect()}
    got = {s["tag_name"]: s for s in answer(spark, f"get_related_tag_window_stats({WINDOW})")["stats"]}
    for tag in TAGS:
        for name in ("point_count", "min_value", "p25_value", "median_value", "p75_value", "max_value"):
            assert got[tag][name] == rows[tag][name]
        for name in ("avg_value", "stddev_value"):
            assert got[tag][name] == pytest.approx(rows[tag][name])


def test_phases_partition_the_window(spark, long, store):
    bounds = [at(0), at(100), at(200), at(360)]
    rows = evidence.phase_stats(long, ["Fan_A"], *bounds).collect()
    assert {r.window_phase: r.point_count for r in rows} == {"before": 100, "during": 100, "after": 160}
    args = ", ".join(f"timestamp'{b}'" for b in bounds)
    got = answer(spark, f"get_before_during_after_stats(array('Fan_A'), {args})")
    assert sorted((s["window_phase"], s["point_count"]) for s in got["stats"]) == sorted(
        (r.window_phase, r.point_count) for r in rows
    )
    assert got["input"]["after_end_ts_utc"] == "2024-07-10 06:00:00"


def test_gaps(spark, long, store):
    rows = {r.tag_name: r for r in evidence.gap_profile(long, ["Fan_B", "Lone"], START, END).collect()}
    # Gaps of exactly 300 s and 900 s are not over the limits.
    assert (rows["Fan_B"].gaps_over_5m, rows["Fan_B"].gaps_over_15m, rows["Fan_B"].max_gap_seconds) == (2, 1, 901)
    assert (rows["Lone"].max_gap_seconds, rows["Lone"].avg_gap_seconds, rows["Lone"].gaps_over_5m) == (None, None, 0)
    call = f"get_missingness_gap_profile(array('Fan_B', 'Lone'), timestamp'{START}', timestamp'{END}')"
    got = {s["tag_name"]: s for s in answer(spark, call)["stats"]}
    assert got["Fan_B"]["gaps_over_15m"] == 1 and got["Fan_B"]["avg_gap_seconds"] == pytest.approx(rows["Fan_B"].avg_gap_seconds)
    assert "max_gap_seconds" not in got["Lone"]


def test_thresholds_match_names_by_spelling(spark, long, store):
    asked = ["FAN B", "fan_b", " fan-a", "missing"]
    matches = {r.requested_tag: r for r in evidence.match_tag_names(long, asked).collect()}
    assert set(matches) == {"FAN B", " fan-a"}
    assert (matches["FAN B"].matched_tag, matches["FAN B"].catalog_point_count) == ("Fan_B", 5)
    rows = evidence.threshold_context(long, asked, START, END, 5.0, 30.0).collect()
    by_tag = {r.matched_tag: r for r in rows}
    assert set(by_tag) == {"Fan_A", "Fan_B", "fan-b"}
    assert by_tag["fan-b"].below_lower_threshold_count == 1
    assert by_tag["Fan_B"].above_upper_threshold_count == 1
    assert by_tag["Fan_A"].first_ts_nzt == "2024-07-10 12:00:00"
    names = ", ".join(f"'{n}'" for n in asked)
    got = answer(spark, f"get_outlier_threshold_context(array({names}), timestamp'{START}', timestamp'{END}', 5D, 30D)")
    assert {m["requested_tag"] for m in got["tag_matches"]} == set(matches)
    assert {s["matched_tag"]: s["above_upper_threshold_count"] for s in got["stats"]} == {
        t: r.above_upper_threshold_count for t, r in by_tag.items()
    }
    assert got["input"]["start_ts_nzt"] == "2024-07-10 12:00:00"


def test_incident_packet(spark, store):
    log, incidents, notes, target = store
    got = answer(spark, f"get_incident_packet('{target}')")
    assert got["status"] == "executed" and len(got["quality_log_rows"]) == 3 and len(got["feedback_rows"]) == 1
    assert got["incident"]["incident_start_utc"] == "2024-07-10 01:00:00"
    none = answer(spark, "get_incident_packet('nothing')")
    assert none["status"] == "not_found" and "incident" not in none and none["quality_log_rows"] == []
    packet = evidence.incident_packet(incidents, log, notes, target)
    assert packet["quality_log_rows"].count() == 3 and packet["feedback_rows"].count() == 1
    everything = evidence.incident_packet_summary(incidents, log, notes).agg(F.sum("log_rows")).first()[0]
    assert everything == 5


def test_incident_report(long, store):
    log, incidents, _, target = store
    rows = {r.incident_id: json.loads(r.report) for r in report.incident_report(incidents, log, long).collect()}
    by_tag = {r["incident"]["tag_name"]: r for r in rows.values()}
    outlier, stuck, lone = by_tag["Fan_A"], by_tag["Fan_B"], by_tag["Lone"]
    assert outlier["threshold_window_count"] == 2
    assert outlier["outlier_trigger"]["breached_thresholds"] == ["lower", "upper"]
    assert outlier["evidence_request"]["status"] == "ready" and outlier["evidence_request"]["tag_names"] == ["Fan_A"]
    assert len(outlier["quality_log_rows"]) == 3
    assert outlier["raw_context"]["row_count"] == 301 and outlier["raw_context"]["latest_value"] == float(300 % 37)
    assert outlier["incident"]["incident_start_nzt"] == "2024-07-10 13:00 NZT"
    assert stuck["outlier_trigger"]["status"] == "not_available" and stuck["evidence_request"]["status"] == "not_ready"
    assert lone["outlier_trigger"]["status"] == "not_available"


def test_raw_context_ends_are_closed(long, store):
    _, incidents, _, target = store
    row = report.raw_context(long, incidents).filter(F.col("incident_id") == target).first()
    # Incident 60..240 minutes, context one hour on both sides, both ends included.
    assert row.row_count == 301
    inside = [m % 37 for m in range(60, 241)]
    assert row.incident_mean == pytest.approx(sum(inside) / len(inside))


def test_first_logs_are_capped(spark, store):
    _, incidents, _, target = store
    log = spark.createDataFrame(
        [(f"r{i:02d}", "st", "src", "Fan_A", "outlier", at(60 + i), at(61 + i), "failed", "{}", at(61)) for i in range(30)],
        MONITOR_LOG,
    )
    rows = report.first_logs(inc.match_logs(incidents, log)).filter(F.col("incident_id") == target).collect()
    assert sorted(r.log_run_id for r in rows) == [f"r{i:02d}" for i in range(12)]
