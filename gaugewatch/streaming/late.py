"""Readings that come behind a watermark: counted, reported and kept."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from gaugewatch.schemas import LONG, TS

MARKS = "highest timestamp, watermark timestamp, arrived long, late long"


class LateRows:
    """Parts each micro-batch at the watermark: rows whose window is still open go on, the others are kept aside.

    The watermark of a batch is the highest time of all batches before it, less ``delay``; a row is
    late if its window of ``window_minutes`` ended by then, or if it has no time. Every row takes
    one of the two ways. A batch has folders of its own number, so a replayed batch is parted at
    the same watermark and writes the same rows; ``on_time`` must bear replays too.
    """

    def __init__(
        self, spark: SparkSession, folder: str, window_minutes: int, delay: timedelta,
        on_time: Callable[[DataFrame, int], None], schema=LONG,
    ):
        self.spark, self.folder, self.delay, self.on_time = spark, folder, delay, on_time
        self.window_seconds = 60 * window_minutes
        none = spark.createDataFrame([], schema).withColumn("watermark", F.lit(None).cast("timestamp"))
        none.write.mode("overwrite").parquet(f"{folder}/late/batch=-1")
        spark.createDataFrame([], MARKS).write.mode("overwrite").parquet(f"{folder}/marks/batch=-1")

    def watermark(self, batch_id: int):
        """From the batches before ``batch_id``; None before the first time."""
        before = self.counts().where(F.col("batch") < batch_id).agg(F.max("highest")).first()[0]
        return None if before is None else before - self.delay

    def keep(self, batch: DataFrame, batch_id: int) -> None:
        mark = F.lit(self.watermark(batch_id)).cast("timestamp")
        # Not F.window, which leaves out rows without time.
        number = F.floor(F.unix_seconds(TS) / self.window_seconds)
        window_end = F.timestamp_seconds((number + 1) * self.window_seconds)
        is_late = F.col(TS).isNull() | F.coalesce(window_end <= mark, F.lit(False))
        arrivals, late = Observation(), Observation()
        # Two passes over the batch: the totals of each are counted while its rows are written.
        seen = batch.observe(arrivals, F.max(TS).alias("highest"), F.count(F.lit(1)).alias("arrived"))
        kept = seen.where(is_late).withColumn("watermark", mark).observe(late, F.count(F.lit(1)).alias("late"))
        kept.write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
        self.on_time(batch.where(~is_late), batch_id)
        # The mark comes last, so a lost batch is done again whole.
        totals = self.spark.createDataFrame(
            [(arrivals.get["highest"], self.watermark(batch_id), arrivals.get["arrived"], late.get["late"])], MARKS
        )
        totals.write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch_id}")

    def writer(self, readings: DataFrame) -> DataStreamWriter:
        return readings.writeStream.foreachBatch(self.keep)

    def read(self) -> DataFrame:
        """The late rows, with the watermark they were behind and the number of their batch."""
        return self.spark.read.parquet(f"{self.folder}/late")

    def counts(self) -> DataFrame:
        """One row per batch: highest time, watermark, rows that arrived and late ones among them."""
        return self.spark.read.parquet(f"{self.folder}/marks")


class DroppedRows(StreamingQueryListener):
    """Counts what Spark's own watermark drops, per query name or identifier.

    An aggregation counts groups of late rows after they were folded in each task, so this tells
    that rows are lost, and at least how many; :class:`LateRows` has them all.
    """

    def __init__(self, report: Callable[[str, int], None] | None = None):
        self.dropped: Counter[str] = Counter()
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        lost = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        if lost:
            name = progress.name or str(progress.id)
            self.dropped[name] += lost
            if self.report:
                self.report(name, lost)

    def onQueryTerminated(self, event) -> None:
        pass
