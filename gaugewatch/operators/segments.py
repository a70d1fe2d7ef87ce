"""Interval merging and gap measurement that survive one very large key.

A window over a whole key would sort all of it in one task. Both operators cut each key
into time slices, work inside the slices, and pass only one summary row per slice along
the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gaugewatch.session import stage

DAY_SECONDS = 86400


def number_groups(
    spans: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    gap_seconds: int,
    slice_seconds: int = DAY_SECONDS,
    group: str = "incident_group",
) -> DataFrame:
    """Number the chains of spans that touch, or lie at most ``gap_seconds`` apart, per key.

    A span joins the chain if it starts no later than the furthest end so far plus the gap,
    so a span inside an earlier, longer one stays in the chain. The spans are staged, as
    they are read once per pass.
    """
    slices = [*keys, "_slice"]
    cut = stage(spans.withColumn("_slice", F.floor(F.unix_seconds(start) / slice_seconds)))
    inside = Window.partitionBy(*slices).orderBy(start, end)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier_slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    carried = (
        cut.groupBy(*slices)
        .agg(F.max(end).alias("_end"))
        .withColumn("_carried_end", F.max("_end").over(earlier_slices))
        .drop("_end")
    )
    reach = F.greatest(F.max(end).over(earlier), F.col("_carried_end"))
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    # Same keys as the windows, hence no further shuffle; left, so that no span gets lost.
    flagged = (
        cut.join(carried, slices, "left")
        .withColumn("_reach", reach)
        .withColumn("_new", F.when(F.col("_reach") >= F.col(start) - gap, 0).otherwise(1))
    )
    started = (
        flagged.groupBy(*slices)
        .agg(F.sum("_new").alias("_started"))
        .withColumn("_before", F.coalesce(F.sum("_started").over(earlier_slices), F.lit(0)))
        .drop("_started")
    )
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        flagged.join(started, slices, "left")
        .withColumn(group, F.coalesce("_before", F.lit(0)) + running)
        .drop("_slice", "_carried_end", "_reach", "_new", "_before")
    )


def gap_totals(
    points: DataFrame,
    keys: list[str],
    ts: str,
    over_seconds: dict[str, int],
    slice_seconds: int = DAY_SECONDS,
    value: str | None = None,
) -> DataFrame:
    """Gaps between consecutive points, in whole seconds, summed up per key.

    Output: keys, point_count, first_ts, last_ts, gap_count, gap_sum, gap_max and one count
    column per entry of ``over_seconds`` (gaps strictly longer). Points of one second are
    first folded together: between n of them lie n - 1 gaps of zero. With ``value``,
    value_count counts the points where that column is there.
    """
    seconds = (
        points.groupBy(*keys, F.unix_seconds(ts).alias("_s"))
        .agg(F.count(F.lit(1)).alias("_n"), F.count(value or F.lit(1)).alias("_values"), F.min(ts).alias("_first_ts"), F.max(ts).alias("_last_ts"))
        .withColumn("_slice", F.floor(F.col("_s") / slice_seconds))
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_s")
    per_slice = (
        seconds.withColumn("_gap", F.col("_s") - F.lag("_s").over(in_slice))
        .groupBy(*keys, "_slice")
        .agg(
            F.sum("_n").alias("_n"),
            F.sum("_values").alias("_values"),
            F.min("_first_ts").alias("_first_ts"),
            F.max("_last_ts").alias("_last_ts"),
            F.min("_s").alias("_first"),
            F.max("_s").alias("_last"),
            F.sum("_gap").alias("_sum"),
            F.max("_gap").alias("_max"),
            F.max(F.when(F.col("_n") > 1, 0)).alias("_zero"),
            *[F.count_if(F.col("_gap") > limit).alias(name) for name, limit in over_seconds.items()],
        )
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    return (
        per_slice.withColumn("_step", F.col("_first") - F.lag("_last").over(along))
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("point_count"),
            *([F.sum("_values").alias("value_count")] if value else []),
            F.min("_first_ts").alias("first_ts"),
            F.max("_last_ts").alias("last_ts"),
            (F.sum("_n") - 1).alias("gap_count"),
            (F.coalesce(F.sum("_sum"), F.lit(0)) + F.coalesce(F.sum("_step"), F.lit(0))).alias("gap_sum"),
            F.max(F.greatest("_max", "_step", "_zero")).alias("gap_max"),
            *[
                (F.sum(name) + F.count_if(F.col("_step") > limit)).alias(name)
                for name, limit in over_seconds.items()
            ],
        )
    )
