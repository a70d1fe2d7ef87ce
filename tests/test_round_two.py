"""What the first review found: one exact path, both feed spellings, table names, null readings."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gaugewatch.config import OutlierRule, RunGrid, StuckValueRule
from gaugewatch.operators.derived import cross_check, derived_tags
from gaugewatch.operators.evidence import gap_profile, near_incidents
from gaugewatch.operators.incidents import merge_incidents
from gaugewatch.operators.outlier import outlier
from gaugewatch.plans.monitoring import merge_arrivals
from gaugewatch.schemas import INCIDENT, LONG, MONITOR_LOG, TAG, TS, VALUE
from gaugewatch.sources import readings
from gaugewatch.sources.tables import IncidentStore
from gaugewatch.streaming.monitors import WindowParts, stuck_value_stream

START = datetime(2024, 1, 1)


def test_one_run_is_judged_as_in_a_grid(spark):
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 400_000)
    long = spark.range(200_000).select(
        stamp.alias(TS), F.lit("a").alias(TAG), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias(VALUE)
    )
    rule = OutlierRule(60, 3)
    grid = RunGrid(START + timedelta(days=3), 3)
    single = RunGrid(START + timedelta(days=3, hours=1), 1)
    shown = ["window_end", "status", "observed_value"]
    several = {r.window_end: tuple(r) for r in outlier(long, ["a"], grid, rule, "s", "t").select(*shown).collect()}
    (one,) = outlier(long, ["a"], single, rule, "s", "t").select(*shown).collect()
    assert several[one.window_end] == tuple(one)


def test_feed_schema_reads_both_spellings(spark, tmp_path):
    source = {"Timestamp": "2024-07-10T09:45:00.1234567Z", "Net Power": 98.5}
    renamed = {"Pi_Timestamp": "2024-07-10T10:45:00.1234567Z", "Net_Power": 97.5}
    for name, row in (("a", source), ("b", renamed)):
        (tmp_path / f"{name}.json").write_text(json.dumps(row))
    raw = readings.read_json(spark, str(tmp_path), readings.feed_schema())
    rows = readings.map_fields(raw).orderBy(TS).select("Net_Power", F.hour(TS).alias("h")).collect()
    assert [(r.Net_Power, r.h) for r in rows] == [(98.5, 9), (97.5, 10)]


def test_incident_store_with_a_mixed_case_name(spark):
    store = IncidentStore(spark, "Monitor_Incident_Two")
    store.ensure()
    for _ in range(3):
        store.replace(store.read())
    assert store.read().count() == 0 and store.read().columns == INCIDENT.fieldNames()


def test_gap_profile_counts_values(spark):
    rows = [(START + timedelta(minutes=m), "a", v) for m, v in ((0, 1.0), (1, None), (2, 2.0))]
    found = gap_profile(spark.createDataFrame(rows, LONG), ["a"], START, START + timedelta(hours=1)).first()
    assert found.point_count == 2


def test_window_parts_lose_no_late_file_and_no_last_window(spark, tmp_path):
    rule = StuckValueRule(60, 1, 5.0, ())
    source = tmp_path / "in"
    parts = WindowParts(spark, str(tmp_path / "parts"), rule)
    written = []
    for hours in (range(5, 10), range(10, 11), range(0, 6)):
        rows = [(START + timedelta(hours=h, minutes=m), "a", float(h + m)) for h in hours for m in (0, 20)]
        spark.createDataFrame(rows, LONG).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(LONG).parquet(str(source))
        query = parts.writer(stream).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        written += rows
    batch = stuck_value_stream(spark.createDataFrame(written, LONG), rule, delay="0 seconds")
    shown = [TAG, "window_start", "valid_count", "min_value", "max_value", "status"]
    assert sorted(parts.read().select(shown).collect()) == sorted(batch.select(shown).collect())
    assert parts.read().count() == 11


def test_late_rows_are_merged_unless_left_out(spark):
    log = monitor_rows(spark, [0, 1, 5, 9])
    stored = merge_incidents(log.filter(F.col("create_ts") > str(START + timedelta(hours=5))), gap_seconds=0)
    assert merge_arrivals(log, stored, with_late=False).count() == stored.count() == 2
    merged = merge_arrivals(log, stored)
    assert merged.count() == merge_incidents(log).count()
    assert sorted(r.incident_start for r in merged.collect())[0] == START


def monitor_rows(spark, hours):
    """Failed rows of one tag, one hour each."""
    rows = []
    for hour in hours:
        start = START + timedelta(hours=hour)
        given = {
            "run_id": f"r{hour:02}", "station": "s", "source_table": "t", TAG: "a", "rule_type": "stuck_value",
            "status": "failed", "window_start": start, "window_end": start + timedelta(hours=1),
            "create_ts": start + timedelta(hours=1),
        }
        rows.append(tuple(given.get(name) for name in MONITOR_LOG.fieldNames()))
    return spark.createDataFrame(rows, MONITOR_LOG)


def test_incident_context_prunes_the_scan(spark, tmp_path):
    rows = [(START + timedelta(hours=h), "a", float(h)) for h in range(48)]
    spark.createDataFrame(rows, LONG).write.parquet(str(tmp_path / "long"))
    long = spark.read.parquet(str(tmp_path / "long"))
    incidents = merge_incidents(monitor_rows(spark, [10]))
    near = near_incidents(long, incidents)
    assert sorted(r[VALUE] for r in near.collect()) == [9.0, 10.0, 11.0, 12.0]
    assert "incident_start" in near._jdf.queryExecution().executedPlan().toString() and near_incidents(long, incidents.limit(0)).count() == 0


def test_derived_measures_and_their_nulls(spark):
    names = [
        "HP_STEAM_FLOW_ALL", "HP_GES_STEAM_SUPPLY", "HP_BRINE_FLOW", "BRINE_FLOW_TO_REINJECTION", "LP_STEAM_FLOW",
        "Total_Turbine_Steam_Flow", "Turbine_Hp_Chamber_Pressure", "Turbine_Lp_Chamber_Pressure", "Condenser_Pressure_A",
    ]
    rows = [
        (500.0, 20.0, 2000.0, 1900.0, 200.0, 700.0, 10.0, 1.5, 0.1),
        (None, 20.0, 5.0, 1900.0, 200.0, 700.0, 1.0, 1.5, 0.1),
        (None,) * 9,
    ]
    wide = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).coalesce(1)
    full, part, none = derived_tags(wide).collect()
    assert full.HP_TURBINE_STEAM_FLOW == 480.0 and abs(full.HP_turbine_steam_flow_calculated - 44.18 * 97.75**0.5) < 1e-9
    assert part.HP_turbine_steam_flow_calculated is None and part.Total_turbine_steam_flow_calculated > 0
    assert none.Total_turbine_steam_flow_calculated is None
    full, part, none = cross_check(wide, wells=("HP_BRINE_FLOW",), least_flow=10.0).collect()
    assert (full.spread, full.Sum_of_wells) == (2620.0 - 2000.0, 2000.0)
    assert (part.Sum_of_wells, part.spread, part.relative_spread) == (0.0, 2620.0, 2.0)
    assert none.spread is None and none.relative_spread is None
