import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from gaugewatch.config import STATION, FreshnessRule, OutlierRule, RunGrid, Settings, StuckValueRule
from gaugewatch.functions.columns import is_numeric, table_ref
from gaugewatch.functions.noise import add_noise, add_noise_keyed
from gaugewatch.operators import incidents as inc, reshape
from gaugewatch.plans.monitoring import monitor_history, run_backfill, run_freshness, run_merge, run_single
from gaugewatch.schemas import FEEDBACK, INCIDENT, INGEST_TS, MONITOR_LOG, TAG, TS, VALUE
from gaugewatch.sources import readings, tables
from gaugewatch.streaming import monitors


def write_json(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rows, indent=1))


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    base = tmp_path_factory.mktemp("feed")
    write_json(
        base / "a.json",
        [
            {"Timestamp": "2024-07-10T09:45:00.1234567Z", "Net Power": 98.4, "Vacuum Pump 40  Current": "No Data", "x": 1},
            {"Timestamp": "2024-07-10T09:45:00.0000000+12:00", "Net Power": "97.5", "Lp Demister Steam Pressure": 3},
        ],
    )
    write_json(base / "deep" / "er" / "b.json", {"Timestamp": "yesterday", "Humidity": 55})
    (base / "c.txt").write_text("not a reading")
    return str(base)


def test_field_mapping(spark, feed):
    mapped = readings.map_fields(readings.read_json(spark, f"  {feed} "))
    assert len(mapped.columns) == 75 and mapped.columns[-2:] == [TS, INGEST_TS]
    assert all(f.dataType == T.DoubleType() for f in mapped.schema.fields[:73])
    rows = sorted(mapped.collect(), key=lambda r: str(r[TS]))
    assert [r[TS] for r in rows] == [datetime(2024, 7, 9, 21, 45), datetime(2024, 7, 10, 9, 45, 0, 123456), None]
    assert [r.Net_Power for r in rows] == [97.5, 98.4, None]
    assert [r.LP_STEAM_PRESSURE_2 for r in rows] == [3.0, None, None]
    assert all(r.Vacuum_Pump_40_Current is None for r in rows) and rows[2].Humidity == 55.0
    with_schema = readings.map_fields(readings.read_json(spark, feed, readings.feed_schema()))
    assert sorted(map(str, with_schema.drop(INGEST_TS).collect())) == sorted(map(str, mapped.drop(INGEST_TS).collect()))


def test_first_existing_name_wins_even_when_empty(spark):
    raw = spark.createDataFrame([(None, 5.0)], "`Net Power` double, Net_Power double")
    assert readings.map_fields(raw).first().Net_Power is None


def test_load_arguments(spark, feed, tmp_path):
    for bad in (lambda: readings.load_json(spark, " ", "t"), lambda: readings.load_json(spark, feed, "t", "merge"),
                lambda: readings.load_json(spark, feed, " ")):
        with pytest.raises(ValueError):
            bad()
    write_json(tmp_path / "none.json", [])
    with pytest.raises(ValueError):
        readings.load_json(spark, str(tmp_path), "loaded_none")
    readings.load_json(spark, feed, "loaded")
    readings.load_json(spark, feed, "loaded", "APPEND")
    assert spark.table("loaded").count() == 6
    readings.load_json(spark, feed, "loaded", "overwrite")
    assert spark.table("loaded").count() == 3


def test_live_ingest_equals_batch(spark, feed, tmp_path):
    stream = readings.map_fields(readings.stream_json(spark, feed)).drop(INGEST_TS)
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    batch = readings.map_fields(readings.read_json(spark, feed, readings.feed_schema())).drop(INGEST_TS)
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_identifiers_and_types():
    assert table_ref("a", "b c", "d") == "`a`.`b c`.`d`"
    for bad in ("a`b", ""):
        with pytest.raises(ValueError):
            table_ref(bad)
    assert is_numeric(T.ShortType()) and is_numeric(T.DecimalType(9, 2))
    assert not is_numeric(T.DayTimeIntervalType()) and not is_numeric(T.StringType())


def test_tag_resolution():
    found, missing = reshape.resolve_tags(["Hp_Brine_Flow", "Humidity"], ["HP_BRINE_FLOW", "gone", "humidity"])
    assert (found, missing) == (["Hp_Brine_Flow", "Humidity"], ["gone"])
    with pytest.raises(ValueError):
        reshape.resolve_tags(["x"], ["y"])
    columns = [TS, "humidity", "Odd_Tag", "Net_Power"]
    assert reshape.available_tags(columns, "ODD_TAG") == ["humidity", "Net_Power", "Odd_Tag"]
    assert reshape.available_tags(columns, "nowhere") == ["humidity", "Net_Power"]


def test_noise(spark):
    df = spark.range(200).select(
        F.timestamp_seconds("id").alias(TS), F.col("id").cast("int").alias("n"), (-F.col("id")).cast("double").alias("d"),
        F.lit("s").alias("text"),
    )
    for noisy in (add_noise(df), add_noise(df, seed=None), add_noise_keyed(df, [TS])):
        assert noisy.columns == df.columns and noisy.schema["n"].dataType == T.DoubleType()
        pairs = noisy.join(df.withColumnRenamed("n", "n0").withColumnRenamed("d", "d0").drop("text"), TS)
        assert pairs.filter("n < n0 OR n > n0 * 1.02 OR d > d0 OR d < d0 * 1.02").isEmpty()
    first = add_noise_keyed(df, [TS]).collect()
    shuffled = add_noise_keyed(df.repartition(7), [TS]).collect()
    assert sorted(first) == sorted(shuffled)
    assert len({r.n / r[TS].timestamp() for r in first if r.n}) > 150


def test_long_form_and_layout(spark):
    wide = spark.createDataFrame(
        [(datetime(2024, 1, 1), 1.0, None), (None, 2.0, 2.0), (datetime(2024, 1, 2), None, 4.0)],
        f"{TS} timestamp, `1st tag` double, b double",
    )
    long = reshape.wide_to_long(wide, ["1st tag", "b"])
    assert sorted((r.tag_name, r.tag_value) for r in long.collect()) == [("1st tag", 1.0), ("b", 4.0)]
    assert reshape.readings_with_nulls(wide, ["1st tag", "b"]).count() == 6
    tables.write_table(wide, "wide_src")
    missing = tables.rebuild_long_table(spark, "wide_src", "long_dst", ["1ST TAG", "B", "c"])
    assert [r.missing_tag for r in missing.collect()] == ["c"]
    assert sorted(spark.table("long_dst").collect()) == sorted(long.collect())
    assert tables.describe_columns(wide)[1] == ("1st tag", "double")
    assert tables.preview(wide, 2).count() == 2


def test_layout_splits_a_hot_tag(spark):
    rows = spark.range(4000).select(
        F.timestamp_seconds("id").alias(TS), F.lit("hot").alias(TAG), F.col("id").cast("double").alias(VALUE)
    )
    sizes = tables.lay_out_long(rows, 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 1500


def test_comparison_forms(spark):
    wide = spark.createDataFrame(
        [(datetime(2024, 1, 1), 1.0, None, 3.0)], f"{TS} timestamp, Humidity double, Net_Power double, Station_Enthalpy double"
    )
    rows = reshape.comparison_long(wide, ["Humidity", "Net_Power"]).collect()
    assert sorted((r.tag, r.display_name, r.value) for r in rows) == [("Humidity", "Humidity", 1.0), ("Net_Power", "Net Power", None)]
    assert reshape.comparison_xy(wide, ["Humidity", "Net_Power"], "Station_Enthalpy").columns == [
        TS, "Humidity", "Net_Power", "Station_Enthalpy"
    ]
    assert reshape.comparison_xy(wide, ["Humidity", "Net_Power"]).columns == [TS, "Humidity", "Net_Power"]
    assert reshape.tag_history(wide, ["Humidity"], datetime(2024, 1, 1), datetime(2024, 1, 1)).count() == 1
    assert tables.incident_history(wide, "Net_Power", datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2)).count() == 1


def test_feedback(spark):
    tables.ensure_feedback_table(spark, "notes")
    tables.ensure_feedback_table(spark, "notes")
    tables.add_feedback(spark, "notes", "i1", "  checked ")
    row = spark.table("notes").first()
    assert (row.incident_id, row.comment) == ("i1", "checked") and row.created_by
    assert spark.table("notes").columns == FEEDBACK.fieldNames()
    with pytest.raises(ValueError):
        tables.add_feedback(spark, "notes", "i1", "  ")


@pytest.fixture(scope="module")
def settings(spark):
    """Two days of three tags: one sticks, one jumps, one is fine."""
    start = datetime(2024, 6, 1)
    minute = F.col("id") % 2880
    wide = spark.range(2880).select(
        F.timestamp_seconds(F.unix_seconds(F.lit(str(start)).cast("timestamp")) + minute * 60).alias(TS),
        F.when(minute.between(600, 839), 7.0).otherwise(10 + (minute * 37) % 11).cast("double").alias("Humidity"),
        F.when(minute.between(2000, 2001), 900.0).otherwise(50 + (minute * 13) % 17).cast("double").alias("Net_Power"),
        F.when(minute < 2800, (minute * 7) % 29 + 1.0).alias("hp_brine_flow"),
    )
    tables.write_table(wide, "station_minutes")
    return Settings(
        source_table="station_minutes", base_table="job_base", noisy_table="job_noisy",
        quality_source_table="station_minutes", monitor_log_table="job_log", incident_table="job_incident",
        history_start=start, history_end=start + timedelta(days=2),
    )


def test_backfill_job(spark, settings):
    run_backfill(spark, settings, fanout=8)
    log = spark.table("job_log")
    assert log.columns == MONITOR_LOG.fieldNames()
    assert log.count() == 48 * 3 * 2
    assert {r.station for r in log.select("station").distinct().collect()} == {STATION}
    found = {(r.tag_name, r.rule_type, r.incident_start.hour, r.incident_end.hour) for r in spark.table("job_incident").collect()}
    assert ("Humidity", "stuck_value", 10, 14) in found
    assert ("Net_Power", "outlier", 9, 10) in found
    before = sorted(spark.table("job_incident").collect())
    run_merge(spark, settings)
    assert sorted(spark.table("job_incident").collect()) == before
    assert len([t for t in spark.catalog.listTables() if t.name.startswith("job_incident_v")]) <= 2


def test_single_run_and_freshness_jobs(spark, settings):
    single = Settings(**(settings.__dict__ | {"monitor_log_table": "single_log"}))
    run_single(spark, single, "stuck_value")
    run_single(spark, single, "outlier", datetime(2024, 6, 2, 9, 45))
    rows = {(r.rule_type, r.tag_name): r.status for r in spark.table("single_log").collect()}
    assert rows["outlier", "Net_Power"] == "failed"
    assert rows["stuck_value", "hp_brine_flow"] == "skipped" and rows["stuck_value", "Net_Power"] == "pass"
    fresh = Settings(**(settings.__dict__ | {"monitor_log_table": "fresh_log"}))
    end = settings.history_end
    run_freshness(spark, fresh, end, end)
    with pytest.raises(RuntimeError):
        run_freshness(spark, fresh, end, end + timedelta(hours=1))
    assert [r.status for r in spark.table("fresh_log").orderBy("status").collect()] == ["failed", "pass"]


def test_history_tables(spark, settings):
    half = Settings(**(settings.__dict__ | {"history_end": settings.history_start + timedelta(days=1)}))
    tables.create_history_tables(spark, half)
    base, noisy = spark.table("job_base"), spark.table("job_noisy")
    assert base.count() == noisy.count() == 1440
    assert noisy.agg(F.sum("Humidity")).first()[0] > base.agg(F.sum("Humidity")).first()[0]


def test_stream_merge_equals_batch(spark, settings, tmp_path):
    wide = spark.table("station_minutes")
    long = reshape.wide_to_long(wide, ["Humidity", "Net_Power", "hp_brine_flow"])
    tags = ["Humidity", "Net_Power", "hp_brine_flow"]
    grid = RunGrid.hourly(settings.history_start, settings.history_end)
    log = monitor_history(
        long, tags, tags, grid, StuckValueRule(60, 60, 9.0, ()), OutlierRule(60, 1, 1.1), "st", "src", fanout=4
    )
    log.repartitionByRange(4, F.desc("create_ts")).write.parquet(str(tmp_path / "log"))
    log = spark.read.schema(MONITOR_LOG).parquet(str(tmp_path / "log"))
    arriving = spark.readStream.schema(MONITOR_LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    store = tables.IncidentStore(spark, "stream_incident")
    query = (
        monitors.incident_stream_to_store(arriving, store)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    keep = [c for c in INCIDENT.fieldNames() if c != "incident_id"]
    assert sorted(store.read().select(keep).collect()) == sorted(inc.merge_incidents(log).select(keep).collect())
    assert store.read().count() > 1


def test_stuck_stream_equals_batch_windows(spark, settings, tmp_path):
    rule = StuckValueRule(60, 60, 9.0, ())
    long = reshape.wide_to_long(spark.table("station_minutes"), ["Humidity", "Net_Power"])
    long.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(long.schema).parquet(str(tmp_path / "in"))
    judged = monitors.stuck_value_stream(stream, rule, delay="0 seconds")
    query = (
        judged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = spark.read.schema(judged.schema).parquet(str(tmp_path / "out"))
    batch = monitors.stuck_value_stream(long, rule, delay="0 seconds").filter(F.col("window_end") < str(settings.history_end))
    assert sorted(got.collect()) == sorted(batch.collect())


def test_freshness_stream(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1),)], f"{TS} timestamp")
    clock = lambda: datetime(2024, 1, 1, 2)
    query = (
        monitors.freshness_stream(spark, lambda: rows, FreshnessRule(30), "st", "src", "stream_fresh", clock)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r.status for r in spark.table("stream_fresh").collect()] == ["failed"]
