"""Streams that keep state between batches: outlier rule, closing incidents, late readings.

Folders of state hold one part per micro-batch, named by its number, so a batch that is
replayed after a failure writes the same part again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugewatch.config import OutlierRule, RunGrid
from gaugewatch.functions.columns import ts_lit
from gaugewatch.operators.incidents import MERGE_GAP_SECONDS, incident_id
from gaugewatch.operators.outlier import outlier
from gaugewatch.operators.runs import of_tags
from gaugewatch.schemas import INCIDENT, INCIDENT_KEYS, LONG, TAG, THRESHOLD_FIELDS, TS
from gaugewatch.session import ship, stage


# ---- parts of a folder -------------------------------------------------------------------------------


class Parts:
    """A folder with one part per micro-batch, laid out by ``partitions``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, partitions: tuple[str, ...] = ()):
        self.spark, self.folder, self.schema, self.partitions = spark, folder, schema, partitions
        # A part without rows lets the folder be read before the first batch.
        self.write(-1, spark.createDataFrame([], schema))

    def write(self, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy(*self.partitions).parquet(f"{self.folder}/batch={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their ``batch``, or those of earlier batches."""
        rows = self.spark.read.schema(f"{self.schema}, batch int").parquet(self.folder)
        return rows if before is None else rows.where(F.col("batch") < before)


# ---- the outlier rule on a stream -----------------------------------------------------------------------


_READING = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LONG)
_JUDGED = (
    f"{TAG} string, run_id string, station string, source_table string, rule_type string, window_start timestamp, "
    "window_end timestamp, create_ts timestamp, status string, observed_value string, "
) + ", ".join(f"{name} double" for name in THRESHOLD_FIELDS)


class OutlierStream:
    """The outlier rule over a stream, judged against a history that the stream itself has stored.

    A batch adds its readings to the stored history, laid out by day, and judges the runs that
    the newest reading so far has passed, from the days their histories reach back to. Readings
    that come late for runs judged before have these judged anew, for their tags only. What
    :meth:`read` gives after :meth:`finish` is what the batch rule gives for all rows at once.
    """

    def __init__(
        self, spark: SparkSession, folder: str, tags: list[str], grid: RunGrid, rule: OutlierRule, station: str,
        source_table: str, **options,
    ):
        self.spark, self.tags, self.grid, self.rule = spark, list(tags), grid, rule
        self.names, self.options = (station, source_table), options
        self.history = Parts(spark, f"{folder}/history", f"{_READING}, day date", ("day",))
        self.progress = Parts(spark, f"{folder}/progress", "newest timestamp, judged int")
        self.judged = Parts(spark, f"{folder}/judged", _JUDGED)

    def _judge(self, long: DataFrame, tags: list[str], first: int, last: int) -> DataFrame:
        step = timedelta(minutes=self.grid.step_minutes)
        part = RunGrid(self.grid.origin + step * (first - 1), last - first + 1, self.grid.step_minutes, self.grid.run_offset)
        return outlier(long, tags, part, self.rule, *self.names, **self.options)

    def _stored(self, first: int, last: int) -> DataFrame:
        """Stored readings that runs ``first`` to ``last`` look at; whole days are pruned."""
        step = timedelta(minutes=self.grid.step_minutes)
        end = self.grid.origin + step * last
        start = self.grid.origin + step * first - timedelta(minutes=self.rule.lookback_minutes, days=self.rule.history_days)
        days = F.col("day").between(F.lit(start.date()), F.lit(end.date()))
        return self.history.read().where(days & (F.col(TS) >= ts_lit(start)) & (F.col(TS) < ts_lit(end))).select(LONG.fieldNames())

    def _run_after(self, at: datetime) -> int:
        """The first run whose window ends after ``at``."""
        return (at - self.grid.origin) // timedelta(minutes=self.grid.step_minutes) + 1

    def _runs(self, tags: list[str], first: int, last: int) -> DataFrame | None:
        first, last = max(1, first), min(self.grid.count, last)
        return self._judge(self._stored(first, last), tags, first, last) if tags and first <= last else None

    def keep(self, batch: DataFrame, batch_id: int) -> None:
        rows = of_tags(batch.select(LONG.fieldNames()), self.tags).withColumn("day", F.to_date(TS))
        self.history.write(batch_id, rows)
        own = self.history.read().where(F.col("batch") == batch_id)
        # One row per watched tag.
        extents = own.groupBy(TAG).agg(F.min(TS).alias("first"), F.max(TS).alias("last")).collect()
        before = self.progress.read(batch_id).agg(F.max("newest").alias("newest"), F.max("judged").alias("judged")).first()
        judged = before.judged or 0
        times = [e["last"] for e in extents if e["last"]] + ([before.newest] if before.newest else [])
        newest = max(times, default=None)
        upto = min(self.grid.count, max(judged, self._run_after(newest) - 1)) if newest else judged
        parts = [self._runs(self.tags, judged + 1, upto)]
        late = [(e[TAG], self._run_after(e["first"])) for e in extents if e["first"] and self._run_after(e["first"]) <= judged]
        if late:
            parts.append(self._runs([tag for tag, _ in late], min(run for _, run in late), judged))
        self._write(batch_id, [p for p in parts if p is not None], newest, upto)

    def _write(self, batch_id: int, parts: list[DataFrame], newest: datetime | None, judged: int) -> None:
        found = self.spark.createDataFrame([], _JUDGED)
        for part in parts:
            found = found.unionByName(part.select(found.columns))
        self.judged.write(batch_id, found)
        row = self.spark.createDataFrame([(newest, judged)], "newest timestamp, judged int")
        self.progress.write(batch_id, row)

    def writer(self, readings: DataFrame) -> DataStreamWriter:
        return readings.writeStream.foreachBatch(self.keep)

    def finish(self) -> None:
        """Judge the runs that no later reading will come to pass, to the end of the grid."""
        seen = self.progress.read().agg(F.max("batch").alias("batch"), F.max("newest").alias("newest"), F.max("judged").alias("judged")).first()
        rest = self._runs(self.tags, (seen.judged or 0) + 1, self.grid.count)
        self._write(seen.batch + 1, [rest] if rest is not None else [], seen.newest, self.grid.count)

    def read(self) -> DataFrame:
        """Every run judged so far, as it was judged last."""
        rows = self.judged.read()
        shown = [c for c in rows.columns if c != "batch"]
        last = rows.groupBy(TAG, "window_end").agg(F.max_by(F.struct(*shown), "batch").alias("row"))
        return last.select("row.*")


# ---- incidents that close by a timer ------------------------------------------------------------------------

_OPEN = "spans string"
_CLOSED = (
    "station string, source_table string, tag_name string, rule_type string, status string, incident_start timestamp, "
    "incident_end timestamp, first_run_id string, last_run_id string, create_ts timestamp, update_ts timestamp"
)


@dataclass
class Span:
    """A chain of failed windows, in microseconds since 1970."""

    start: int
    end: int
    first_run: str
    last_run: str
    created: int
    updated: int

    def take(self, other: Span) -> None:
        """The same rules as in the batch merge of one set of rows."""
        self.start, self.end = min(self.start, other.start), max(self.end, other.end)
        self.first_run, self.last_run = min(self.first_run, other.first_run), max(self.last_run, other.last_run)
        self.created, self.updated = min(self.created, other.created), max(self.updated, other.updated)


def chain(spans: list[Span], gap: int) -> list[Span]:
    """Spans joined where one starts no later than ``gap`` after the furthest end before it."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: (s.start, s.end)):
        if out and span.start <= out[-1].end + gap:
            out[-1].take(span)
        else:
            out.append(span)
    return out


def closing_incidents(log: DataFrame, delay: str, gap_seconds: int = MERGE_GAP_SECONDS) -> DataFrame:
    """Incidents of a stream of log rows, each once, when the watermark has passed its end by the gap.

    Every key keeps its open chains only, so a batch costs its own rows and the keys they
    touch, whatever was closed before. Rows in any order within ``delay`` give what the batch
    merge gives; later ones are dropped by Spark, which counts them (``LateCounter``). The
    watermark is that of window starts, so nothing still to come can touch a closed chain.
    """
    ship(log.sparkSession)
    gap = gap_seconds * 1_000_000
    timed = log.withWatermark("window_start", delay)
    # One condition that also names the time: rows that passed must move the watermark too.
    failed = timed.where(F.when(F.col("window_start").isNotNull(), F.col("status") == "failed"))
    micros = {"start": "window_start", "end": "window_end", "created": "create_ts"}
    rows = failed.select(
        *INCIDENT_KEYS, "window_start", "run_id", *[F.unix_micros(c).alias(name) for name, c in micros.items()]
    )

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [Span(*s) for s in json.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                for start, end, run, created in frame[["start", "end", "run_id", "created"]].itertuples(index=False):
                    held.append(Span(int(start), int(end), run, run, int(created), int(created)))
        passed = state.getCurrentWatermarkMs() * 1000
        spans = chain(held, gap)
        closed = [s for s in spans if s.end + gap < passed]
        still = [s for s in spans if s.end + gap >= passed]
        if still:
            state.update((json.dumps([list(vars(s).values()) for s in still]),))
            # The millisecond at which the earliest of them has surely ended.
            ends = (min(s.end for s in still) + gap) // 1000 + 1
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, ends))
        elif state.exists:
            state.remove()
        if closed:
            at = lambda values: pd.to_datetime(pd.Series(list(values)), unit="us")
            yield pd.DataFrame(
                {
                    **{name: [part] * len(closed) for name, part in zip(INCIDENT_KEYS, key)},
                    "incident_start": at(s.start for s in closed),
                    "incident_end": at(s.end for s in closed),
                    "first_run_id": [s.first_run for s in closed],
                    "last_run_id": [s.last_run for s in closed],
                    "create_ts": at(s.created for s in closed),
                    "update_ts": at(s.updated for s in closed),
                }
            )

    found = rows.groupBy(*INCIDENT_KEYS).applyInPandasWithState(
        follow, _CLOSED, _OPEN, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.withColumn("incident_id", incident_id(F.col("incident_start"))).select(INCIDENT.fieldNames())


# ---- late readings ---------------------------------------------------------------------------------------------


class LateCounter(StreamingQueryListener):
    """Adds up the rows that the stateful operators of streaming queries dropped behind the watermark."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + rows

    def onQueryTerminated(self, event) -> None:
        pass


class LateGate:
    """Parts a stream into rows in time and rows behind the watermark, which are counted and kept.

    The watermark of a batch is the newest time of all earlier batches less the delay, as Spark
    has it. Rows in time go to ``forward``; late ones are stored with their batch.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: str, delay: timedelta, forward: Callable[[DataFrame, int], None], time: str = TS
    ):
        self.spark, self.delay, self.forward, self.time = spark, delay, forward, time
        self.late = Parts(spark, f"{folder}/late", schema)
        self.marks = Parts(spark, f"{folder}/marks", "newest timestamp, rows long, late_rows long")

    def keep(self, batch: DataFrame, batch_id: int) -> None:
        rows = stage(batch)
        newest = self.marks.read(batch_id).agg(F.max("newest")).first()[0]
        behind = F.lit(False) if newest is None else F.coalesce(F.col(self.time) < ts_lit(newest - self.delay), F.lit(False))
        self.late.write(batch_id, rows.where(behind))
        self.forward(rows.where(~behind), batch_id)
        marks = rows.agg(F.max(self.time).alias("newest"), F.count(F.lit(1)).alias("rows"), F.count_if(behind).alias("late_rows"))
        self.marks.write(batch_id, marks)

    def writer(self, rows: DataFrame) -> DataStreamWriter:
        return rows.writeStream.foreachBatch(self.keep)

    def late_rows(self) -> DataFrame:
        """All late rows, with the batch they came in."""
        return self.late.read()

    def counts(self) -> DataFrame:
        """Rows and late rows of every batch."""
        return self.marks.read().where(F.col("batch") >= 0).select("batch", "rows", "late_rows")
