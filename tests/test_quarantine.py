"""Records that cannot be read as they should, at rest and arriving; rows behind the watermark."""

import json
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from gaugewatch.plans.demo import QUERIES
from gaugewatch.plans.oracles import ORACLES
from gaugewatch.schemas import TS
from gaugewatch.sources import quarantine
from gaugewatch.streaming.late import DroppedRows, LateRows
from gaugewatch.streaming.monitors import tumbling_extrema

FIELDS = {"Net Power": "Net_Power", "Humidity": "Humidity"}
STAMP = "2024-06-01T00:00:00.0000000Z"


@pytest.mark.parametrize("name", ["load_json", "late_readings"])
def test_query_agrees_with_its_sql(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
        wanted = db.sql(ORACLES[name]).df()
    assert len(wanted) > 5
    as_rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert sorted(found.columns) == sorted(wanted.columns)
    assert as_rows(found) == as_rows(wanted)


@pytest.fixture
def feed(tmp_path):
    (tmp_path / "feed").mkdir()
    good = {"Net Power": "1.5", "Humidity": 40, "Timestamp": STAMP}
    files = {
        "a": json.dumps([good, {"Net Power": "No Data", "Timestamp": STAMP}]),
        "b": json.dumps({"Net_Power": "2", "Pi_Timestamp": "yesterday"}),
        "c": '{"Net Power": "3", ',
        "d": json.dumps({"Humidity": None}),
    }
    for name, text in files.items():
        (tmp_path / "feed" / f"{name}.json").write_text(text)
    return str(tmp_path / "feed")


def _seen(rejects):
    rows = rejects.select(F.regexp_extract("source_file", r"(\w)\.json$", 1), "problems", "loaded", "record").collect()
    return sorted((name, [(p["field"], p["reason"], p["found"]) for p in problems], loaded) for name, problems, loaded, _ in rows)


EXPECTED = [
    ("a", [("Net_Power", "not a number", "No Data")], True),
    ("b", [(TS, "not a time", "yesterday")], False),
    ("c", [(None, "not JSON", None)], False),
    ("d", [(TS, "no time", None)], False),
]


def test_load_with_rejects(spark, feed, tmp_path):
    quarantine.load_with_rejects(spark, feed, "kept_rows", "rejected_rows", fields=FIELDS)
    assert sorted(map(str, (r[:] for r in spark.table("kept_rows").select("Net_Power", "Humidity").collect()))) == [
        "(1.5, 40.0)", "(None, None)",
    ]
    assert _seen(spark.table("rejected_rows")) == EXPECTED
    assert '{"Net Power": "3", ' in [r.record for r in spark.table("rejected_rows").collect()]
    quarantine.load_with_rejects(spark, feed, "kept_rows", "rejected_rows", "append", FIELDS)
    assert (spark.table("kept_rows").count(), spark.table("rejected_rows").count()) == (4, 8)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        quarantine.load_with_rejects(spark, str(tmp_path / "none"), "kept_rows", "rejected_rows", fields=FIELDS)
    assert spark.table("kept_rows").count() == 4


def test_extra_columns_and_empty_tables(spark):
    raw = spark.createDataFrame([("x", STAMP, "mine", "own")], "`Net Power` string, Timestamp string, record string, loaded string")
    row = quarantine.examine(raw, FIELDS).first()
    assert row["loaded"] is True and json.loads(row["record"]) == {"Net Power": "x", "Timestamp": STAMP}
    assert quarantine.examine(raw.limit(0), FIELDS).count() == 0


def test_quarantine_stream(spark, feed, tmp_path):
    stream = quarantine.QuarantineStream(spark, str(tmp_path / "out"), FIELDS)
    assert stream.loaded().count() == stream.rejects().count() == 0
    for _ in range(2):  # a second start finds nothing new
        writer = stream.writer(feed).option("checkpointLocation", str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
    assert _seen(stream.rejects()) == EXPECTED
    assert stream.loaded().count() == 2
    batch = spark.read.json(feed, multiLine=True).limit(0)
    stream.keep(batch, 7), stream.keep(batch, 7)
    assert stream.loaded().count() == 2


def test_late_rows_are_counted_and_kept(spark, long_frame, tmp_path):
    taken = {}
    late = LateRows(spark, str(tmp_path / "late"), 60, timedelta(hours=2), lambda df, n: taken.update({n: df.count()}))
    batches = [[("a", 0, 1.0), ("a", 300, 2.0)], [("a", 170, 3.0), ("a", 190, 4.0), ("a", 400, 5.0)], []]
    for _ in range(2):  # batches that are replayed change nothing
        for number, rows in enumerate(batches):
            late.keep(long_frame(rows) if rows else long_frame(batches[0]).limit(0), number)
    # The watermark of batch 1 is 180 minutes: a window that ends there is closed, the next one is open.
    assert [r.tag_value for r in late.read().collect()] == [3.0]
    assert late.read().first().watermark == datetime(2024, 1, 1, 3)
    counts = {r.batch: (r.arrived, r.late) for r in late.counts().collect()}
    assert counts == {0: (2, 0), 1: (3, 1), 2: (0, 0)} and taken == {0: 2, 1: 2, 2: 0}


def test_rows_without_time_are_late(spark, long_frame, tmp_path):
    late = LateRows(spark, str(tmp_path / "late"), 60, timedelta(0), lambda df, n: None)
    late.keep(long_frame([("a", 0, 1.0)]).withColumn(TS, F.lit(None).cast("timestamp")), 0)
    assert late.read().count() == 1 and late.watermark(1) is None


def test_spark_drops_are_reported(spark, long_frame, tmp_path):
    listener, told = DroppedRows(lambda name, n: told.append((name, n))), []
    spark.streams.addListener(listener)
    try:
        source = str(tmp_path / "in")
        for rows in ([("a", 0, 1.0), ("a", 3000, 2.0)], [("a", 1, 3.0), ("a", 3100, 1.0)]):
            long_frame(rows).coalesce(1).write.mode("append").parquet(source)
            found = tumbling_extrema(spark.readStream.schema(long_frame(rows).schema).parquet(source), 60, "0 seconds")
            writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).queryName("windows")
            query = writer.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
            query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped["windows"] == 1 and told == [("windows", 1)]
