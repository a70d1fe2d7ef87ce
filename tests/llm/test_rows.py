"""Decisions by row where identifiers are null or repeat."""

from pyspark.sql import functions as F

import corpus_pipeline
from gaugewatch.llm import decontaminate
from gaugewatch.llm.common import row_key, ship

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
CLEAN = "a plain text about the weather of today and of the days after"
OTHER = "one more text that has nothing in common with any of the rest"
SECRET = "here password = hunter2hunter2 is set"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def kept(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)


def test_benchmark_hits_go_by_row(spark):
    ship(spark)
    rows = [(None, ITEM, "a"), (None, CLEAN, "a"), (1, ITEM + " " + ITEM, "a"), (1, "x " + ITEM, "a"), (1, CLEAN, "a"), (2, None, "a")]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    found = decontaminate.contamination(frame(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found) == [
        ("1", 11, 10, 1, True), ("1", 13, 0, 0, False), ("1", 20, 20, 1, True),
        ("2", 0, 0, 0, False), ("None", 10, 10, 1, True), ("None", 13, 0, 0, False),
    ]


def test_pipeline_drops_dirty_rows_only(spark, tmp_path):
    ship(spark)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for dirty, step in ((ITEM, corpus_pipeline.drop_benchmark_text), (SECRET, corpus_pipeline.drop_secrets)):
        docs = frame(spark, [(i, t, "a") for i in (None, 1, 2) for t in (dirty, CLEAN)] + [(None, None, "a")])
        want = [(i, CLEAN) for i in (None, 1, 2)] + [(None, None)]
        assert kept(step(spark, docs, str(tmp_path))) == sorted(want, key=str)


def test_near_copies_go_by_row(spark):
    ship(spark)
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(None, long + " z", "a"), (3, long, "a"), (3, CLEAN, "a"), (5, long + " y", "a"), (3, CLEAN, "b"), (None, OTHER, "a"), (None, OTHER, "a")]
    found = corpus_pipeline.keep_one_of_near_copies(spark, frame(spark, rows), "")
    assert sorted((str(r.doc_id), r.text) for r in found.collect()) == [("3", CLEAN), ("3", long), ("None", OTHER)]


def test_row_keys_tell_nulls_and_borders(spark):
    rows = [("a", None), (None, "a"), ("a", ""), ("", "a"), ("-", "-"), (None, None), ("1:a", "b"), ("1", "a:b")]
    keys = spark.createDataFrame(rows, "a string, b string").select(row_key(["a", "b"]).alias("k"))
    assert keys.where(F.col("k").isNotNull()).distinct().count() == len(rows)
