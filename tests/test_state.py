"""Streams with state: they end as the batch does, and a batch that runs again changes nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugewatch.config import FreshnessRule, OutlierRule, RunGrid, StuckValueRule
from gaugewatch.operators import sketches, trailing
from gaugewatch.operators.incidents import merge_incidents
from gaugewatch.operators.outlier import outlier
from gaugewatch.operators.runs import tag_runs
from gaugewatch.operators.stuck import stuck_value
from gaugewatch.schemas import INCIDENT, LONG, MONITOR_LOG, TAG, TS
from gaugewatch.sources.tables import LogParts, MonthlyIncidents
from gaugewatch.streaming import monitors, state

START = datetime(2024, 1, 1)


def readings(seed, hours=60, tags=("a", "b")):
    draw = random.Random(seed)
    rows = []
    for tag in tags:
        for _ in range(hours * 6):
            minute = draw.uniform(0, hours * 60)
            if tag == "b" and 600 < minute < 800:
                continue  # windows without readings
            rows.append((START + timedelta(minutes=minute), tag, draw.choice([5.0, draw.gauss(0, 10), draw.gauss(0, 60)])))
    return sorted(rows)


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_outlier_stream_ends_as_the_batch(spark, tmp_path):
    rows = readings(1)
    late = [r for i, r in enumerate(rows) if i % 40 == 7]
    files = [rows[:200], rows[200:500], late, rows[500:]]
    files = [[r for r in part if part is late or r not in late] for part in files]
    grid, rule, tags = RunGrid(START, 62), OutlierRule(60, 1, 1.2), ["a", "b", "absent"]
    stream = state.OutlierStream(spark, str(tmp_path / "s"), tags, grid, rule, "st", "src", fanout=4)
    for i, part in enumerate(files):
        spark.createDataFrame(part, LONG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(stream.writer(spark.readStream.schema(LONG).parquet(str(tmp_path / "in"))), tmp_path / "c")
        if i == 1:
            assert 0 < stream.read().count() < 62 * 3
    stream.finish()
    shown = [TAG, "run_id", "window_start", "window_end", "status", "observed_value", "history_p1", "history_p99"]
    batch = outlier(spark.createDataFrame(rows, LONG), tags, grid, rule, "st", "src", fanout=4)
    assert sorted(map(str, stream.read().select(shown).collect())) == sorted(map(str, batch.select(shown).collect()))
    # The last batch once more.
    before = stream.judged.read().count()
    stream.keep(spark.createDataFrame(files[-1], LONG), 3)
    assert stream.judged.read().count() == before


def log_rows(spark, hours, tag="a", status="failed"):
    rows = []
    for hour in hours:
        start = START + timedelta(hours=hour)
        given = {
            "run_id": f"r{hour:06.1f}", "station": "s", "source_table": "t", TAG: tag, "rule_type": "stuck_value", "status": status,
            "window_start": start, "window_end": start + timedelta(hours=1), "create_ts": start + timedelta(hours=1),
        }
        rows.append(tuple(given.get(name) for name in MONITOR_LOG.fieldNames()))
    return spark.createDataFrame(rows, MONITOR_LOG)


def test_closing_incidents_equal_the_merge(spark, tmp_path):
    hours = {"a": [0, 1, 2, 5, 6, 9, 20, 21.5], "b": [3, 4, 12]}
    whole = log_rows(spark, hours["a"]).unionByName(log_rows(spark, hours["b"], "b"))
    source, counts = str(tmp_path / "in"), []
    # Out of order within the delay; rows that passed move the watermark on.
    parts = [([1, 0, 5], [4, 3], [6]), ([2, 6, 9], [12], [11, 12]), ([20, 21.5], [], [30]), ([], [], [5000])]
    for a, b, passed in parts:
        frame = log_rows(spark, a).unionByName(log_rows(spark, b, "b")).unionByName(log_rows(spark, passed, "c", "pass"))
        frame.coalesce(1).write.mode("append").parquet(source)
        found = state.closing_incidents(spark.readStream.schema(MONITOR_LOG).parquet(source), "8 hours")
        query = (
            found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        counts.append(spark.read.schema(INCIDENT).parquet(str(tmp_path / "out")).count())
    got = spark.read.schema(INCIDENT).parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(merge_incidents(whole).collect())
    # Early incidents are there before the stream ends.
    assert counts == sorted(counts) and 0 < counts[2] <= counts[3]


def test_late_rows_are_dropped_counted_and_kept(spark, tmp_path):
    source, listener = str(tmp_path / "in"), state.LateCounter()
    spark.streams.addListener(listener)
    gate_rows = []
    gate = state.LateGate(
        spark, str(tmp_path / "gate"), "Pi_Timestamp timestamp, tag_name string, tag_value double",
        timedelta(hours=1), lambda rows, batch: gate_rows.append((batch, rows.count())),
    )
    rule = StuckValueRule(60, 1, 5.0, ())
    # The third file is late for hours 1 and 2.
    for hours in ([0, 1, 2], [10, 11], [1, 2, 11], [30]):
        rows = [(START + timedelta(hours=h, minutes=5), "a", float(h)) for h in hours]
        spark.createDataFrame(rows, LONG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LONG).parquet(source)
        judged = monitors.stuck_value_stream(stream, rule, delay="1 hour")
        query = (
            judged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        run(gate.writer(spark.readStream.schema(LONG).parquet(source)), tmp_path / "g")
    for _ in range(50):
        if any(listener.dropped.values()):
            break
        import time

        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert max(listener.dropped.values()) == 2
    late = gate.late_rows()
    assert sorted(r[TS].hour for r in late.collect()) == [1, 2] and {r["batch"] for r in late.collect()} == {2}
    assert [(r["rows"], r["late_rows"]) for r in gate.counts().orderBy("batch").collect()] == [(3, 0), (2, 0), (3, 2), (1, 0)]
    assert gate_rows == [(0, 3), (1, 2), (2, 1), (3, 1)]


def test_windows_without_readings_are_skipped_and_parts_fold(spark, tmp_path):
    rows, rule, tags = readings(4), StuckValueRule(60, 2, 8.0, ("a",)), ["a", "b", "absent"]
    grid = RunGrid(START, 61)
    parts = monitors.WindowParts(spark, str(tmp_path / "p"), rule)
    for i in range(5):
        parts.keep(spark.createDataFrame(rows[i::5], LONG), i)
        if i == 2:
            parts.fold(1)
    shown = [TAG, "run_id", "window_start", "status", "valid_count", "min_value", "max_value"]
    batch = sorted(map(str, stuck_value(spark.createDataFrame(rows, LONG), tags, grid, rule, "s", "t").select(shown).collect()))
    assert any("skipped" in r for r in batch)
    judged = lambda: sorted(map(str, parts.judge(tags, grid, "s", "t").select(shown).collect()))
    assert judged() == batch
    parts.fold(4)
    assert judged() == batch and len(parts.unread()) == 6
    parts.fold(2)  # nothing to do
    assert judged() == batch


def test_timer_judges_runs_once(spark, tmp_path):
    rule, grid = StuckValueRule(60, 2, 8.0, ()), RunGrid(START, 10)
    parts = monitors.WindowParts(spark, str(tmp_path / "p"), rule)
    parts.keep(spark.createDataFrame(readings(5, hours=4, tags=("a",)), LONG), 0)
    log, times = LogParts(spark, "timer_log"), iter([START + timedelta(hours=3), START + timedelta(hours=20)])
    for _ in range(2):
        run(parts.judge_on_timer(["a", "x"], grid, "s", "t", log, lambda: next(times)), tmp_path / "c")
    rows = log.read().collect()
    assert len(rows) == 20 and len({(r[TAG], r["window_end"]) for r in rows}) == 20
    assert {r["status"] for r in rows if r[TAG] == "x"} == {"skipped"}


def test_a_tick_that_runs_again_writes_its_rows_once(spark):
    rows = spark.createDataFrame([(START,)], f"{TS} timestamp")
    log = LogParts(spark, "replayed_log")
    log.ensure()
    judged = monitors.freshness(rows, FreshnessRule(30), START, "s", "t", START + timedelta(hours=2))
    for batch in (0, 1, 1, 0):
        log.write(judged, "freshness/s/t", batch)
    log.write(judged, "other", 0)
    assert log.read().count() == 3 and log.has("other", 0) and not log.has("other", 1)


def files_of(spark, name):
    return {r[0] for r in spark.table(name).select(F.input_file_name()).distinct().collect()}


def test_monthly_incidents_rewrite_what_changes(spark):
    store = MonthlyIncidents(spark, "monthly_incident")
    store.ensure()
    year = log_rows(spark, [24 * d + h for d in range(0, 366, 3) for h in (0, 1, 7)])
    store.merge(year)
    one_hour = log_rows(spark, [24 * 150 + 2])
    before = files_of(spark, store.name)
    assert store.merge(one_hour) == [("2024-05", "2024-05")]
    changed = before ^ files_of(spark, store.name)
    assert changed and all("start_month=2024-05" in path for path in changed)
    assert store.merge(one_hour) == []
    both = year.unionByName(one_hour)
    keep = [c for c in INCIDENT.fieldNames() if c != "incident_id"]
    assert sorted(store.read().select(keep).collect()) == sorted(merge_incidents(both).select(keep).collect())


def test_monthly_incidents_across_months_leave_no_empty_partition(spark):
    store = MonthlyIncidents(spark, "monthly_edges")
    store.ensure()
    store.merge(log_rows(spark, [31 * 24 - 2]))  # ends in January
    store.merge(log_rows(spark, [31 * 24 + 1]))  # starts in February
    store.merge(log_rows(spark, [31 * 24 - 1, 31 * 24]))  # joins both
    (row,) = store.read().collect()
    assert (row["incident_start"], row["incident_end"]) == (START + timedelta(hours=742), START + timedelta(hours=746))
    partitions = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {store.name}").collect()}
    assert partitions == {"start_month=2024-01/end_month=2024-02"}


@pytest.mark.parametrize("k", [8, sketches.K])
def test_sketches_stay_within_their_error(spark, long_frame, k):
    draw = random.Random(7)
    rows = [("hot", draw.uniform(-3000, 3000), draw.gauss(0, 9)) for _ in range(3000)] + [("cold", 5.0, 1.0), ("cold", 9.0, None)]
    long, grid, history = long_frame(rows), RunGrid(START, 50), timedelta(hours=40)
    cells = sketches.sketch_cells(long, grid, 60, k)
    # Readings that come later are rows of their own.
    half = long.withColumn("half", F.pmod(F.xxhash64(TS), F.lit(2)))
    cells = sketches.sketch_cells(half.where("half = 0"), grid, 60, k).unionByName(sketches.sketch_cells(half.where("half = 1"), grid, 60, k))
    runs = tag_runs(spark, ["hot", "cold"], grid)
    got = sketches.trailing_sketch_percentiles(cells, runs, grid, 60, history)
    exact = trailing.fenced_history_percentiles(long, runs, grid, 60, history, fanout=4)
    pairs = {(r[TAG], r["run_no"]): r for r in exact.collect()}
    found = got.collect()
    assert {(r[TAG], r["run_no"]): r["history_count"] for r in found} == {key: r["history_count"] for key, r in pairs.items()}
    bounds = got.select(TAG, "run_no", F.lit("q1").alias("target"), F.col("history_q1").alias("bound"))
    ranks = trailing.ranks_in_history(long, bounds, grid, 60, history, fanout=4).collect()
    assert len(ranks) == len(found)
    allowed = min(1.0, sketches.rank_error(k))
    for r in ranks:
        n = pairs[r[TAG], r["run_no"]]["history_count"]
        assert r["n_below"] - allowed * n - 1 <= 0.25 * n <= r["n_upto"] + allowed * n + 1
    if k == sketches.K:  # histories this short are held whole
        assert all(r["history_q3"] == pairs[r[TAG], r["run_no"]]["history_q3"] for r in found)
