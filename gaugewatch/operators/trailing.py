"""Exact percentiles over a long trailing history, for every run at once.

A reading lies in thousands of overlapping histories (90 days, one run per hour), so
pairing readings with runs is out of the question. Instead each tag's values are cut into
``fanout`` buckets of about equal size, and the readings become counts per bucket and time
cell. The counts slide along the runs as running sums of what enters and what leaves, which
tells the bucket that holds a wanted rank in each run. Only the readings of the chosen
buckets are shuffled, and paired with the runs that chose them: a ``1/fanout`` part of the
history per run. They meet in slices of the time axis, an eighth of a history long: a slice
that lies whole in a history answers with its counts per value, and only the two slices at the
history's ends with readings by cell. So a run meets what it needs and little more, however
long the table, and a frequent tag is many tasks. Long histories are narrowed over several
levels, the chosen buckets being cut again each time. Every answer is an actual reading with
the exact rank; the cuts only steer the amount of work.
"""

from __future__ import annotations

from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.config import RunGrid
from gaugewatch.operators.ranks import cut_groups, cuts_below, nearest_rank
from gaugewatch.operators.runs import at_minutes, cell_index
from gaugewatch.schemas import TAG, TS, VALUE
from gaugewatch.session import stage

IQR_FENCE = 1.5

# A further level pays once the pairs of readings and runs outnumber its own counts this often.
PAIRS_PER_COUNT = 4

# Slices of the time axis in one history.
SLICES_PER_HISTORY = 8


class History:
    """Cell arithmetic of ``[window start - history, window start)`` along a run grid."""

    def __init__(self, grid: RunGrid, lookback_minutes: int, history_minutes: int):
        self.grid = grid
        self.cell_minutes = gcd(gcd(grid.step_minutes, lookback_minutes), history_minutes)
        self.step = grid.step_minutes // self.cell_minutes
        self.lookback = lookback_minutes // self.cell_minutes
        self.span = history_minutes // self.cell_minutes

    def end(self, run_no: Column) -> Column:
        return run_no * self.step - self.lookback

    def start(self, run_no: Column) -> Column:
        return self.end(run_no) - self.span

    @property
    def slice_cells(self) -> int:
        return max(1, self.span // SLICES_PER_HISTORY)

    def first_run(self, cell: Column) -> Column:
        """First run whose history holds the cell."""
        return (F.floor((cell + self.lookback) / self.step) + 1).cast("int")

    def first_run_after(self, cell: Column) -> Column:
        """First run whose history has left the cell behind."""
        return (F.floor((cell + self.lookback + self.span) / self.step) + 1).cast("int")

    def readings(self, long: DataFrame) -> DataFrame:
        """Readings that any history holds, with their time cells."""
        start = self.cell_minutes * (self.step - self.lookback - self.span)
        end = self.cell_minutes * (self.step * self.grid.count - self.lookback)
        return long.filter(
            (F.col(TS) >= at_minutes(self.grid, start))
            & (F.col(TS) < at_minutes(self.grid, end))
            & F.col(VALUE).isNotNull()
        ).select(
            TAG, VALUE, cell_index(self.grid, self.cell_minutes).alias("cell"), F.lit(0).cast("long").alias("node")
        )


class BucketLevel:
    """Readings cut into buckets, with the count of every bucket in every run's history."""

    def __init__(self, readings: DataFrame, wanted_runs: DataFrame, history: History, fanout: int):
        self.fanout = fanout
        self.cuts = stage(cut_groups(readings, [TAG, "node"], VALUE, fanout))
        self.readings = stage(
            readings.join(self.cuts, [TAG, "node"])
            .withColumn("bucket", self.bucket_of(F.col(VALUE)))
            .drop("cuts")
        )
        self.counts = stage(self._slide(wanted_runs, history))

    def bucket_of(self, value: Column) -> Column:
        return cuts_below(value, self.fanout)

    def _slide(self, wanted_runs: DataFrame, history: History) -> DataFrame:
        per_cell = self.readings.groupBy(TAG, "node", "bucket", "cell").agg(F.count(F.lit(1)).alias("n"))
        enter = F.struct(
            F.greatest(history.first_run(F.col("cell")), F.lit(1)).alias("run_no"), F.col("n").alias("change")
        )
        leave = F.struct(history.first_run_after(F.col("cell")).alias("run_no"), (-F.col("n")).alias("change"))
        changes = (
            per_cell.select(TAG, "node", "bucket", F.explode(F.array(enter, leave)).alias("move"))
            .select(TAG, "node", "bucket", "move.run_no", "move.change", F.lit(False).alias("wanted"))
            .filter(F.col("run_no") <= history.grid.count)
        )
        dense = wanted_runs.select(
            TAG,
            "node",
            F.explode(F.sequence(F.lit(0), F.lit(self.fanout - 1))).alias("bucket"),
            "run_no",
            F.lit(0).cast("long").alias("change"),
            F.lit(True).alias("wanted"),
        )
        along_runs = (
            Window.partitionBy(TAG, "node", "bucket").orderBy("run_no").rangeBetween(Window.unboundedPreceding, 0)
        )
        across = Window.partitionBy(TAG, "node", "run_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        return (
            changes.unionByName(dense)
            .withColumn("n", F.sum("change").over(along_runs))
            .filter("wanted")
            .withColumn("upto", F.sum("n").over(across))
            .select(TAG, "node", "run_no", "bucket", (F.col("upto") - F.col("n")).alias("before"), "upto")
        )

    def narrow(self, requests: DataFrame) -> DataFrame:
        """Move each request into the bucket that holds its rank or its bound."""
        placed = (
            requests.join(self.cuts, [TAG, "node"])
            .withColumn("home", F.when(F.col("bound").isNotNull(), self.bucket_of(F.col("bound"))))
            .drop("cuts")
        )
        holds_rank = (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto"))
        return (
            placed.join(self.counts, [TAG, "node", "run_no"])
            .filter(F.coalesce(F.col("home") == F.col("bucket"), holds_rank))
            .select(
                TAG,
                (F.col("node") * self.fanout + F.col("bucket")).alias("node"),
                "run_no",
                "target",
                (F.col("rank") - F.col("before")).alias("rank"),
                "bound",
                (F.col("below") + F.col("before")).alias("below"),
            )
        )

    def children(self) -> DataFrame:
        return self.readings.withColumn("node", F.col("node") * self.fanout + F.col("bucket")).drop("bucket")


def _descend(top: BucketLevel, requests: DataFrame, history: History, levels: int) -> tuple[DataFrame, DataFrame]:
    level = top
    requests = stage(level.narrow(requests))
    for _ in range(levels - 1):
        chosen = requests.select(TAG, "node").distinct()
        deeper = level.children().join(chosen, [TAG, "node"], "left_semi")
        level = BucketLevel(deeper, requests.select(TAG, "node", "run_no").distinct(), history, top.fanout)
        requests = stage(level.narrow(requests))
    return level.children(), requests


def _levels_needed(top: BucketLevel) -> int:
    """Enough that the pairs to look at stay in proportion to the readings themselves.

    Takes two totals: the sizes of all histories, and the readings (from file footers).
    """
    histories, runs = (
        top.counts.filter(F.col("bucket") == top.fanout - 1)
        .agg(F.coalesce(F.sum("upto"), F.lit(0)), F.count(F.lit(1)))
        .first()
    )
    ranks_per_run = 2
    counts_per_level = runs * ranks_per_run * top.fanout
    affordable = max(top.readings.count(), PAIRS_PER_COUNT * counts_per_level)
    levels = 1
    while ranks_per_run * histories > affordable * top.fanout**levels:
        levels += 1
    return levels


def meet_in_slices(readings: DataFrame, requests: DataFrame, history: History) -> DataFrame:
    """Pairs of a request and the readings of its node, folded, of every time slice its history touches.

    A slice that the history covers whole has one row per value (``cell`` is null); the slices
    at its ends have one per cell and value, which may lie outside the history.
    """
    size = history.slice_cells
    sliced = readings.withColumn("slice", F.floor(F.col("cell") / size))
    counted = F.count(F.lit(1)).alias("n")
    by_cell = sliced.groupBy(TAG, "node", "slice", "cell", VALUE).agg(counted)
    by_slice = sliced.groupBy(TAG, "node", "slice", VALUE).agg(counted)
    start, end = history.start(F.col("run_no")), history.end(F.col("run_no"))
    touched = F.sequence(F.floor(start / size), F.floor((end - 1) / size))
    asked = requests.withColumn("slice", F.explode(touched))
    whole = (F.col("slice") * size >= start) & ((F.col("slice") + 1) * size <= end)
    keys = [TAG, "node", "slice"]
    covered = by_slice.join(asked.filter(whole), keys).withColumn("cell", F.lit(None).cast("long"))
    return by_cell.join(asked.filter(~whole), keys).unionByName(covered)


def _in_history(readings: DataFrame, requests: DataFrame, history: History) -> DataFrame:
    """Values of the requests' buckets that lie in their histories, with how often they occur."""
    chosen = readings.join(requests.select(TAG, "node").distinct(), [TAG, "node"], "left_semi")
    inside = (F.col("cell") >= history.start(F.col("run_no"))) & (F.col("cell") < history.end(F.col("run_no")))
    return meet_in_slices(chosen, requests, history).filter(F.col("cell").isNull() | inside)


def _values_at(top: BucketLevel, requests: DataFrame, history: History, levels: int) -> DataFrame:
    """(tag, run_no, target, value): the reading at each wanted rank.

    Equal values may come from several cells; whichever row crosses the rank has the value.
    """
    readings, requests = _descend(top, requests, history, levels)
    by_value = Window.partitionBy(TAG, "run_no", "target").orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _in_history(readings, requests, history)
        .withColumn("upto", F.sum("n").over(by_value))
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select(TAG, "run_no", "target", F.col(VALUE).alias("value"))
    )


def _count_below(top: BucketLevel, requests: DataFrame, history: History, levels: int) -> DataFrame:
    """(tag, run_no, target, n): readings under each bound; a target that starts with ``upto`` counts the bound itself."""
    readings, requests = _descend(top, requests, history, levels)
    counted = F.col("target").startswith("upto")
    under = F.when(counted, F.col(VALUE) <= F.col("bound")).otherwise(F.col(VALUE) < F.col("bound"))
    inside = (
        _in_history(readings, requests, history)
        .filter(under)
        .groupBy(TAG, "run_no", "target")
        .agg(F.sum("n").alias("inside"))
    )
    return requests.join(inside, [TAG, "run_no", "target"], "left").select(
        TAG, "run_no", "target", (F.col("below") + F.coalesce("inside", F.lit(0))).alias("n")
    )


def _requests(base: DataFrame, **targets: tuple[str, Column]) -> DataFrame:
    """One request row per target; each target is ('rank' | 'bound', expression)."""
    null_rank, null_bound = F.lit(None).cast("long"), F.lit(None).cast("double")
    asked = [
        F.struct(
            F.lit(name).alias("target"),
            (value.cast("long") if kind == "rank" else null_rank).alias("rank"),
            (value if kind == "bound" else null_bound).alias("bound"),
        )
        for name, (kind, value) in targets.items()
    ]
    return base.select(
        TAG,
        F.lit(0).cast("long").alias("node"),
        "run_no",
        F.explode(F.array(*asked)).alias("ask"),
        F.lit(0).cast("long").alias("below"),
    ).select(TAG, "node", "run_no", "ask.target", "ask.rank", "ask.bound", "below")


def _spread(found: DataFrame, value: str, *targets: str) -> DataFrame:
    return found.groupBy(TAG, "run_no").agg(
        *[F.max(F.when(F.col("target") == target, F.col(value))).alias(target) for target in targets]
    )


def fences(q1: Column, q3: Column) -> tuple[Column, Column]:
    reach = (q3 - q1) * IQR_FENCE
    return q1 - reach, q3 + reach


def fenced_history_percentiles(
    long: DataFrame,
    tag_run_grid: DataFrame,
    grid: RunGrid,
    lookback_minutes: int,
    history: timedelta,
    fanout: int = 256,
    levels: int | None = None,
) -> DataFrame:
    """Quartiles, fences and fenced p1 / p99 of each run's trailing history.

    Output: tag_name, run_no, history_count, history_q1, history_q3, lower_fence,
    upper_fence, history_p1, history_p99; no row where the history is empty.
    ``fanout`` must be a power of two; ``levels`` follows from the data unless given.
    """
    if fanout & (fanout - 1) or fanout < 2:
        raise ValueError("fanout must be a power of two")
    span = History(grid, lookback_minutes, int(history / timedelta(minutes=1)))
    wanted = tag_run_grid.select(TAG, "run_no", F.lit(0).cast("long").alias("node"))
    top = BucketLevel(span.readings(long), wanted, span, fanout)
    levels = levels or _levels_needed(top)

    totals = top.counts.filter((F.col("bucket") == fanout - 1) & (F.col("upto") > 0)).select(
        TAG, "run_no", F.col("upto").alias("history_count")
    )
    n = F.col("history_count")
    quartile_ranks = _requests(totals, q1=("rank", nearest_rank(0.25, n)), q3=("rank", nearest_rank(0.75, n)))
    quartiles = _spread(_values_at(top, quartile_ranks, span, levels), "value", "q1", "q3")
    lower, upper = fences(F.col("q1"), F.col("q3"))
    bounds = stage(
        totals.join(quartiles, [TAG, "run_no"]).withColumn("lower_fence", lower).withColumn("upper_fence", upper)
    )

    edges = _requests(bounds, under=("bound", F.col("lower_fence")), upto=("bound", F.col("upper_fence")))
    inside = _spread(_count_below(top, edges, span, levels), "n", "under", "upto")
    kept = F.col("upto") - F.col("under")
    tail_ranks = _requests(
        inside.filter(kept > 0),
        p1=("rank", F.col("under") + nearest_rank(0.01, kept)),
        p99=("rank", F.col("under") + nearest_rank(0.99, kept)),
    )
    tails = _spread(_values_at(top, tail_ranks, span, levels), "value", "p1", "p99")
    return bounds.join(tails, [TAG, "run_no"], "left").select(
        TAG,
        "run_no",
        "history_count",
        F.col("q1").alias("history_q1"),
        F.col("q3").alias("history_q3"),
        "lower_fence",
        "upper_fence",
        F.col("p1").alias("history_p1"),
        F.col("p99").alias("history_p99"),
    )


def ranks_in_history(
    long: DataFrame,
    asked: DataFrame,
    grid: RunGrid,
    lookback_minutes: int,
    history: timedelta,
    fanout: int = 256,
    levels: int | None = None,
) -> DataFrame:
    """tag_name, run_no, target, n_below and n_upto: how many readings of the run's history lie below, and up to, a bound.

    ``asked`` has tag_name, run_no, target and bound, targets being different for each run; runs
    with an empty history have no row.
    """
    span = History(grid, lookback_minutes, int(history / timedelta(minutes=1)))
    asked = stage(asked.select(TAG, "run_no", "target", F.col("bound").cast("double").alias("bound")))
    wanted = asked.select(TAG, "run_no", F.lit(0).cast("long").alias("node")).distinct()
    top = BucketLevel(span.readings(long), wanted, span, fanout)
    levels = levels or _levels_needed(top)
    zero = F.lit(0).cast("long")
    # Whether the bound itself counts goes with the target's name.
    both = asked.withColumn("side", F.explode(F.array(F.lit("under"), F.lit("upto"))))
    requests = both.select(
        TAG, zero.alias("node"), "run_no", F.concat("side", F.lit(":"), "target").alias("target"),
        F.lit(None).cast("long").alias("rank"), "bound", zero.alias("below"),
    )
    found = _count_below(top, requests, span, levels)
    side, name = F.substring_index("target", ":", 1), F.expr("substring(target, locate(':', target) + 1)")
    return found.groupBy(TAG, "run_no", name.alias("target")).agg(
        F.max(F.when(side == "under", F.col("n"))).alias("n_below"),
        F.max(F.when(side == "upto", F.col("n"))).alias("n_upto"),
    )
