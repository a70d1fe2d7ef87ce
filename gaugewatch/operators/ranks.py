"""Exact quantiles of any groups, by selection on counted cuts.

A small group is sorted. A large one is cut into intervals of about equal size, its readings
are only counted (before anything is shuffled), and the counts tell which interval holds each
wanted rank; the readings of these intervals alone go on, and are cut again while they are too
many. A value that occurs often is a cut, and cuts have counts of their own, so a rank that
falls on one needs no readings at all.

Cuts are found in two steps: sketches of the input partitions are merged slice by slice, then
the slices' cuts by their weights, so that one large group is many tasks. They only steer the
work; every answer is a reading of exactly the wanted rank.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.functions.columns import percentiles
from gaugewatch.schemas import VALUE
from gaugewatch.session import stage

#: Readings of a group, or of an interval of one, that one task sorts; more are cut first.
SORTED_ROWS = 1_000_000
#: Intervals of a cut, and slices of the input partitions whose sketches are merged apart.
FANOUT, SLICES = 256, 64


def nearest_rank(share: float, n: Column) -> Column:
    """The rank, from 1, of the smallest reading that ``share`` of ``n`` readings do not exceed."""
    return F.greatest(F.ceil(F.lit(share) * n), F.lit(1)).cast("long")


def join_on(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, a null being equal to a null; the keys of ``rows`` stay."""
    renamed = other.select(*[F.col(k).alias(f"_other_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"_other_{k}" for k in keys])


def cut_groups(rows: DataFrame, keys: list[str], value: str, fanout: int, slices: int = SLICES) -> DataFrame:
    """keys and cuts: fewer than ``fanout`` rising values that part each group into about equal shares."""
    shares = [i / fanout for i in range(1, fanout)]
    sliced = rows.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
    # Rough cuts will do, and keep the partial sketches of a large group small.
    parts = sliced.groupBy(*keys, "_slice").agg(
        percentiles(F.col(value), shares, 16 * fanout).alias("cuts"), F.count(value).alias("n")
    )
    points = parts.select(*keys, F.explode("cuts").alias("cut"), "n")
    whole = Window.partitionBy(*keys)
    upto = F.sum("n").over(whole.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0))
    points = points.withColumn("upto", upto).withColumn("total", F.sum("n").over(whole))
    step = lambda n: F.floor(n.cast("double") * fanout / F.col("total"))
    crossed = points.where(step(F.col("upto")) > step(F.col("upto") - F.col("n")))
    return crossed.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_set("cut")), 1, fanout - 1).alias("cuts")
    )


def cuts_below(value: Column, fanout: int) -> Column:
    """How many of ``cuts`` lie below the value, by binary search."""
    halves = [1 << i for i in reversed(range(int(log2(fanout))))]
    return F.aggregate(
        F.array(*[F.lit(h) for h in halves]),
        F.lit(0),
        lambda at, half: F.when(F.get("cuts", at + half - 1) < value, at + half).otherwise(at),
    )


def _sorted_answers(rows: DataFrame, keys: list[str], value: str, asked: DataFrame) -> DataFrame:
    """keys, target and value: the reading at each asked rank of its group, by sorting the group's different values."""
    folded = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    by_value = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = folded.withColumn("upto", F.sum("n").over(by_value))
    lists = asked.groupBy(*keys).agg(F.collect_list(F.struct("target", "rank")).alias("asks"))
    met = lambda ask: (ask["rank"] <= F.col("upto")) & (ask["rank"] > F.col("upto") - F.col("n"))
    found = join_on(summed, lists, keys).withColumn("ask", F.explode(F.filter("asks", met)))
    return found.select(*keys, F.col("ask.target").alias("target"), F.col(value).alias("value"))


def exact_quantiles(
    rows: DataFrame,
    keys: list[str],
    shares: dict[str, float],
    value: str = VALUE,
    totals: DataFrame | None = None,
    fanout: int = FANOUT,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """keys and one column per share: the reading of that nearest rank among the group's non-null readings.

    Groups without readings have no row; null keys are a group; NaN is the largest value.
    ``totals`` (keys and n, the non-null readings) saves a pass where the caller has them,
    staged. ``fanout`` must be a power of two.
    """
    if fanout & (fanout - 1) or fanout < 2:
        raise ValueError("fanout must be a power of two")
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    if totals is None:
        totals = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    asks = [F.struct(F.lit(t).alias("target"), nearest_rank(p, F.col("n")).alias("rank")) for t, p in shares.items()]
    asked = totals.where(F.col("n") > 0).select(*keys, "n", F.explode(F.array(*asks)).alias("ask"))
    asked = asked.select(*keys, F.lit(0).cast("long").alias("node"), "ask.target", "ask.rank", F.col("n").alias("held"))
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    own = [*keys, "node"]
    answers = []
    while True:
        few, many = asked.where(F.col("held") <= sorted_rows), asked.where(F.col("held") > sorted_rows)
        cut = not many.isEmpty()
        small = join_on(rows, few.select(*own).distinct(), own, "left_semi") if cut else rows
        answers.append(_sorted_answers(small, own, "_value", few).drop("node"))
        if not cut:
            break
        large = join_on(rows, many.select(*own).distinct(), own, "left_semi")
        cuts = stage(cut_groups(large, own, "_value", fanout))
        placed = join_on(large, cuts, own).withColumn("below", cuts_below(F.col("_value"), fanout))
        # Even places lie between two cuts, odd ones are a cut.
        on_cut = F.coalesce((F.get("cuts", F.col("below")) == F.col("_value")).cast("int"), F.lit(0))
        placed = placed.withColumn("place", 2 * F.col("below") + on_cut).drop("cuts", "below")
        counts = placed.groupBy(*own, "place").agg(F.count(F.lit(1)).alias("here"))
        along = Window.partitionBy(*own).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        counts = stage(counts.withColumn("upto", F.sum("here").over(along)))
        inside = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("here"))
        found = join_on(join_on(many, counts, own).where(inside), cuts, own)
        found = stage(
            found.select(
                *keys,
                (F.col("node") * (2 * fanout) + F.col("place")).alias("node"),
                "target",
                (F.col("rank") - F.col("upto") + F.col("here")).alias("rank"),
                F.col("here").alias("held"),
                F.when(F.col("place") % 2 == 1, F.get("cuts", F.floor(F.col("place") / 2).cast("int"))).alias("value"),
            )
        )
        answers.append(found.where(F.col("value").isNotNull()).select(*keys, "target", "value"))
        asked = found.where(F.col("value").isNull()).drop("value")
        deeper = placed.withColumn("node", F.col("node") * (2 * fanout) + F.col("place")).drop("place")
        rows = stage(join_on(deeper, asked.select(*own).distinct(), own, "left_semi"))
    every = reduce(DataFrame.unionByName, answers)
    return every.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in shares])


def group_quantiles(
    rows: DataFrame,
    keys: list[str],
    shares: dict[str, float],
    value: str = VALUE,
    accuracy: int | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """keys and one column per share: exact, or with an ``accuracy`` from one sketch per group (rank error n / accuracy)."""
    if accuracy is None:
        return exact_quantiles(rows, keys, shares, value, totals)
    sketched = rows.groupBy(*keys).agg(percentiles(F.col(value), list(shares.values()), accuracy).alias("_q"))
    return sketched.select(*keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(shares)])
