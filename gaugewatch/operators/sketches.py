"""Trailing percentiles from stored sketches.

A KLL sketch of every tag and time cell is a mergeable state: it is written once, later readings
of the cell add a row, and the sketches of any stretch of time merge into one. A run's history
is made of whole blocks of cells, merged beforehand, and of single cells at its two ends, so a
run merges about twice the root of the cells in its history rather than all of them, and no
reading is looked at again.

Ranks are off by at most about ``rank_error(k)`` of the history's readings, which is the
price against :mod:`gaugewatch.operators.trailing`; a history of fewer than ``k`` readings
keeps them all.
"""

from __future__ import annotations

from datetime import timedelta
from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

from gaugewatch.config import RunGrid
from gaugewatch.operators.runs import cell_index
from gaugewatch.operators.trailing import History, fences
from gaugewatch.schemas import TAG, VALUE

#: The size parameter of a sketch.
K = 1600
#: A sketch is asked for this many evenly spaced quantiles to find the rank of a fence, since Spark answers constant ranks only.
STEPS = 1000


def rank_error(k: int = K) -> float:
    """Three times the published normalized rank error of a KLL sketch, which 99 % of the answers keep."""
    return 3 * 2.296 / k**0.9723


def tail_error(k: int = K) -> float:
    """The rank error of p1 and p99: two fences and the quantile itself, each off by a sketch's error and a step."""
    return 3 * (rank_error(k) + 1 / STEPS)


def sketch_cells(long: DataFrame, grid: RunGrid, cell_minutes: int, k: int = K) -> DataFrame:
    """tag_name, cell, n and sketch of the non-null readings of each time cell, relative to the grid's origin.

    Rows of later readings of the same cells may simply be added.
    """
    cells = long.where(F.col(VALUE).isNotNull()).withColumn("cell", cell_index(grid, cell_minutes))
    return cells.groupBy(TAG, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(VALUE, k).alias("sketch")
    )


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")]


def _steps(first: Column, last: Column, level: int) -> Column:
    """(level, place) from ``first`` to ``last``, none if there are none."""
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(places, lambda at: F.struct(F.lit(level).alias("level"), at.alias("place")))


def trailing_sketches(cells: DataFrame, runs: DataFrame, history: History) -> DataFrame:
    """tag_name, run_no, n and the merged sketch of each run's history; no row where it is empty.

    ``cells`` has the cells of ``history``; ``runs`` tag_name and run_no.
    """
    size = max(1, isqrt(history.span))
    blocks = cells.withColumn("cell", F.floor(F.col("cell") / size)).groupBy(TAG, "cell").agg(*_merged())
    pieces = cells.withColumn("level", F.lit(0)).unionByName(blocks.withColumn("level", F.lit(1)))
    start, end = history.start(F.col("run_no")), history.end(F.col("run_no"))
    first = F.ceil(start / size)
    after = F.greatest(F.floor(end / size), first)
    # Whole blocks from first up to after; the cells before and after them.
    edge = F.least(first * size, end)
    wanted = F.concat(
        _steps(first, after - 1, 1), _steps(start.cast("bigint"), edge - 1, 0), _steps(F.greatest(after * size, edge), end - 1, 0)
    )
    asked = runs.select(TAG, "run_no", F.explode(wanted).alias("at"))
    asked = asked.select(TAG, "run_no", F.col("at.level").alias("level"), F.col("at.place").alias("cell"))
    return pieces.join(asked, [TAG, "level", "cell"]).groupBy(TAG, "run_no").agg(*_merged())


def trailing_sketch_percentiles(
    cells: DataFrame, tag_run_grid: DataFrame, grid: RunGrid, lookback_minutes: int, history: timedelta
) -> DataFrame:
    """The columns of ``fenced_history_percentiles``, from the stored sketches of ``History.cell_minutes`` cells.

    Quartiles are off by ``rank_error``; p1 and p99 are taken at the ranks that the fences
    have among ``STEPS`` quantiles of the same sketch, and are off by ``tail_error`` at most.
    """
    span = History(grid, lookback_minutes, int(history / timedelta(minutes=1)))
    merged = trailing_sketches(cells, tag_run_grid, span)
    places = F.lit([i / STEPS for i in range(STEPS + 1)])
    spread = merged.select(TAG, "run_no", "n", F.kll_sketch_get_quantile_double("sketch", places).alias("steps"))
    at = lambda place: F.element_at("steps", (F.round(place) + 1).cast("int"))
    quartiles = spread.withColumn("history_q1", at(F.lit(STEPS / 4))).withColumn("history_q3", at(F.lit(STEPS * 3 / 4)))
    lower, upper = fences(F.col("history_q1"), F.col("history_q3"))
    bounds = quartiles.withColumn("lower_fence", lower).withColumn("upper_fence", upper)
    # The places of the first and the last quantile within the fences; quartiles always are.
    under = F.size(F.filter("steps", lambda v: v < F.col("lower_fence")))
    upto = F.size(F.filter("steps", lambda v: v <= F.col("upper_fence"))) - 1
    ranked = bounds.withColumn("under", under).withColumn("upto", upto)
    inside = lambda share: F.col("under") + (F.col("upto") - F.col("under")) * share
    return ranked.select(
        TAG,
        "run_no",
        F.col("n").alias("history_count"),
        "history_q1",
        "history_q3",
        "lower_fence",
        "upper_fence",
        at(inside(0.01)).alias("history_p1"),
        at(inside(0.99)).alias("history_p99"),
    )
