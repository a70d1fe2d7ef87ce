"""Exact quantiles against a plain version, whatever the groups' sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugewatch.operators import ranks

SHARES = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "top": 1.0}


def plain(rows, keys):
    groups = {}
    for *key, value in rows:
        if value is not None:
            groups.setdefault(tuple(key), []).append(value)
    order = lambda v: (math.isnan(v), v if not math.isnan(v) else 0)
    out = []
    for key, values in groups.items():
        values.sort(key=order)
        out.append((*key, *[values[max(1, math.ceil(p * len(values))) - 1] for p in SHARES.values()]))
    return sorted(map(repr, out))


def collected(found, keys):
    return sorted(repr(tuple(r)) for r in found.select(*keys, *SHARES).collect())


def readings(seed=1):
    rng = random.Random(seed)
    rows = [("hot", 1, rng.gauss(0, 10)) for _ in range(3000)]
    rows += [("hot", 1, 7.5)] * 2000  # one value with a third of a group
    rows += [("same", 2, 3.0)] * 1500
    rows += [("small", i % 3, float(i)) for i in range(40)]
    rows += [(None, 1, rng.random()) for _ in range(900)] + [("nulls", None, None)] * 5 + [("odd", None, 1.0)]
    rows += [("ends", 4, v) for v in (math.inf, -math.inf, math.nan, 0.0, 1.0) for _ in range(200)]
    rows += [("two", 5, float(i % 2)) for i in range(1200)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("fanout", "sorted_rows"), [(256, 10**6), (4, 100), (16, 20), (2, 500)])
def test_exact_at_any_size(spark, fanout, sorted_rows):
    rows = readings()
    df = spark.createDataFrame(rows, "tag_name string, part int, tag_value double").repartition(7)
    found = ranks.exact_quantiles(df, ["tag_name", "part"], SHARES, fanout=fanout, sorted_rows=sorted_rows)
    assert collected(found, ["tag_name", "part"]) == plain(rows, 2)


def test_large_groups_pass_on_few_readings(spark, monkeypatch):
    """Of a group that is cut, only the intervals that hold a wanted rank are kept."""
    kept = []
    stage = ranks.stage

    def counting(df):
        out = stage(df)
        if "_value" in out.columns:
            kept.append(out.count())
        return out

    monkeypatch.setattr(ranks, "stage", counting)
    df = spark.range(40_000).select(F.lit("a").alias("tag_name"), F.rand(3).alias("tag_value"))
    found = ranks.exact_quantiles(df, ["tag_name"], {"p50": 0.5, "p99": 0.99}, fanout=64, sorted_rows=5000).collect()
    values = sorted(r["tag_value"] for r in df.collect())
    assert (found[0]["p50"], found[0]["p99"]) == (values[19_999], values[39_599])
    assert len(kept) == 1 and kept[0] < 40_000 * 2 * 3 / 64


def test_no_rows_and_bad_fanout(spark):
    none = spark.createDataFrame([], "tag_name string, tag_value double")
    assert ranks.exact_quantiles(none, ["tag_name"], SHARES).count() == 0
    with pytest.raises(ValueError):
        ranks.exact_quantiles(none, ["tag_name"], SHARES, fanout=3)


def test_cuts_part_a_group_evenly(spark):
    df = spark.range(20_000).repartition(9).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    cuts = ranks.cut_groups(df, ["k"], "v", 16, slices=3).first()["cuts"]
    sizes = [b - a for a, b in zip([0.0, *cuts], [*cuts, 20_000.0])]
    assert cuts == sorted(cuts) and len(cuts) <= 15 and max(sizes) < 3 * 20_000 / 16
