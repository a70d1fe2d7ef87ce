"""The monitors as streaming queries.

Each uses the batch operators or the same expressions, so a finished stream and a batch run
over the same rows agree.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from gaugewatch.config import FreshnessRule, RunGrid, StuckValueRule
from gaugewatch.functions.columns import blank_zero
from gaugewatch.operators.freshness import freshness
from gaugewatch.operators.incidents import MERGE_GAP_SECONDS, merge_incidents
from gaugewatch.operators.runs import origin_seconds
from gaugewatch.operators.stuck import stuck_value
from gaugewatch.schemas import INCIDENT, INCIDENT_KEYS, LONG, TAG, TS, VALUE
from gaugewatch.session import stage
from gaugewatch.sources.tables import IncidentStore, LogParts, MonthlyIncidents


def tumbling_extrema(
    readings: DataFrame, window_minutes: int, delay: str, zero_filtered: tuple[str, ...] = ()
) -> DataFrame:
    """Count, min and max per tag and tumbling window.

    On a stream a window comes out once the watermark has passed its end; later readings
    for it are dropped, and windows after the watermark stay open. :class:`WindowParts`
    loses neither.
    """
    kept = blank_zero(F.col(TAG), F.col(VALUE), zero_filtered)
    timed = readings.withWatermark(TS, delay) if readings.isStreaming else readings
    return (
        timed.groupBy(F.window(TS, f"{window_minutes} minutes").alias("w"), TAG)
        .agg(F.count(kept).alias("valid_count"), F.min(kept).alias("min_value"), F.max(kept).alias("max_value"))
        .select(
            TAG,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "valid_count",
            "min_value",
            "max_value",
        )
    )


def stuck_value_stream(readings: DataFrame, rule: StuckValueRule, delay: str) -> DataFrame:
    """Stuck-value status of every tumbling window that has readings.

    A window without any reading of a tag produces no row on a stream; the batch rule
    reports it as skipped.
    """
    return judge_windows(tumbling_extrema(readings, rule.lookback_minutes, delay, rule.zero_filtered_tags), rule)


def judge_windows(windows: DataFrame, rule: StuckValueRule) -> DataFrame:
    """The stuck-value status of windows that have their count, minimum and maximum."""
    usable = (F.col("valid_count") >= rule.min_expected_rows) & F.col("min_value").isNotNull()
    span = F.when(usable, F.col("max_value") - F.col("min_value"))
    return windows.withColumn(
        "status",
        F.when(span.isNull(), "skipped").when(span <= rule.max_range, "failed").otherwise("pass"),
    )


class WindowParts:
    """Tumbling windows of a stream without a watermark: no reading comes too late for its window.

    Each micro-batch leaves its counts, minima and maxima per tag and window in a folder of
    its own number, so a replayed batch writes the same folder again. Windows are merged from
    their parts when they are read; one that is still filling shows what it has so far.
    :meth:`fold` keeps the number of parts small, :meth:`judge` and :meth:`judge_on_timer` report the windows
    of a run grid that had no readings.
    """

    def __init__(self, spark: SparkSession, folder: str, rule: StuckValueRule):
        self.spark, self.folder, self.rule = spark, folder, rule
        # Parts without rows let the windows be read before the first batch.
        empty = self._part(spark.createDataFrame([], LONG))
        empty.write.mode("overwrite").parquet(f"{folder}/parts/batch=-1")
        empty.withColumn("folded", F.lit(None).cast("int")).write.mode("overwrite").parquet(f"{folder}/folded/upto=-1")

    def _part(self, readings: DataFrame) -> DataFrame:
        return tumbling_extrema(readings, self.rule.lookback_minutes, "0 seconds", self.rule.zero_filtered_tags)

    def keep(self, batch: DataFrame, batch_id: int) -> None:
        self._part(batch).write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch_id}")

    def writer(self, readings: DataFrame) -> DataStreamWriter:
        return readings.writeStream.foreachBatch(self.keep)

    def _folded_upto(self) -> int:
        folded = self.spark.read.parquet(f"{self.folder}/folded")
        return folded.agg(F.coalesce(F.max("folded"), F.lit(-1))).first()[0]

    def windows(self) -> DataFrame:
        """Count, minimum and maximum of every window that has readings."""
        upto = self._folded_upto()
        parts = self.spark.read.parquet(f"{self.folder}/parts").where(F.col("batch") > upto).drop("batch")
        folded = self.spark.read.parquet(f"{self.folder}/folded").where(F.col("upto") == upto).drop("upto", "folded")
        windows = parts.unionByName(folded).where(F.col(TAG).isNotNull()).groupBy(TAG, "window_start", "window_end")
        return windows.agg(
            F.sum("valid_count").alias("valid_count"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")
        )

    def fold(self, upto: int) -> None:
        """Merge the parts of all batches up to ``upto`` into one row per window.

        The newest complete folding counts, so a lost job changes nothing; parts and foldings
        that it replaces are no longer read and may be deleted (:meth:`unread`).
        """
        before = self._folded_upto()
        if upto <= before:
            return
        parts = self.spark.read.parquet(f"{self.folder}/parts").where((F.col("batch") > before) & (F.col("batch") <= upto))
        folded = self.spark.read.parquet(f"{self.folder}/folded").where(F.col("upto") == before)
        merged = parts.drop("batch").unionByName(folded.drop("upto", "folded")).where(F.col(TAG).isNotNull())
        merged = merged.groupBy(TAG, "window_start", "window_end").agg(
            F.sum("valid_count").alias("valid_count"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")
        )
        # A row without window names the folding; it is there when all of it is.
        mark = self.spark.range(1).select(F.lit(upto).alias("folded"))
        rows = merged.unionByName(mark, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.folder}/folded/upto={upto}")

    def unread(self) -> list[str]:
        """Folders that no reader looks at any more."""
        upto = self._folded_upto()
        names = {"parts": "batch", "folded": "upto"}
        out = []
        for kind, column in names.items():
            numbers = self.spark.read.parquet(f"{self.folder}/{kind}").select(column).distinct().collect()
            gone = [n for (n,) in numbers if (n <= upto if kind == "parts" else n < upto) and n >= 0]
            out += [f"{self.folder}/{kind}/{column}={n}" for n in sorted(gone)]
        return out

    def read(self) -> DataFrame:
        """The judged windows of all batches so far that have readings."""
        return judge_windows(self.windows(), self.rule)

    def judge(self, tags: list[str], grid: RunGrid, station: str, source_table: str) -> DataFrame:
        """Every tag in every run of the grid, from the parts: a window without readings is ``skipped``.

        The runs' windows must be the tumbling ones, one after the other.
        """
        if grid.step_minutes != self.rule.lookback_minutes:
            raise ValueError("runs must be as far apart as their windows are long")
        ended = (F.unix_seconds("window_end") - origin_seconds(grid)) / (60 * grid.step_minutes)
        extrema = self.windows().withColumn("run_no", ended.cast("int"))
        return stuck_value(self.spark.createDataFrame([], LONG), tags, grid, self.rule, station, source_table, extrema)

    def judge_on_timer(
        self,
        tags: list[str],
        grid: RunGrid,
        station: str,
        source_table: str,
        log: LogParts,
        clock: Callable[[], datetime] | None = None,
        settle: timedelta = timedelta(0),
        every: str = "5 minutes",
    ) -> DataStreamWriter:
        """Write the log of runs that ended, ``settle`` ago, since the tick before, with or without readings.

        Each tick's rows are kept by its number, so a replayed tick writes its runs once.
        """
        clock, stream = clock or _utc_now, f"stuck_value/{station}/{source_table}"
        log.ensure()

        def tick(_tick: DataFrame, batch_id: int) -> None:
            if log.has(stream, batch_id):
                return
            step = timedelta(minutes=grid.step_minutes)
            done = log.read_stream(stream).agg(F.max("window_end")).first()[0]
            first = (done - grid.origin) // step + 1 if done else 1
            last = min(grid.count, (clock() - settle - grid.origin) // step)
            if first > last:
                return
            part = RunGrid(grid.origin + step * (first - 1), last - first + 1, grid.step_minutes, grid.run_offset)
            log.write(self.judge(tags, part, station, source_table), stream, batch_id)

        ticks = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        return ticks.writeStream.foreachBatch(tick).trigger(processingTime=every)


def incident_stream(
    log: DataFrame, read: Callable[[], DataFrame], replace: Callable[[DataFrame], None],
    gap_seconds: int = MERGE_GAP_SECONDS,
) -> DataStreamWriter:
    """Merge each micro-batch of log rows into the stored incidents.

    Merging is idempotent, so a batch replayed after a failure changes nothing. Late rows
    are merged as well.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        replace(merge_incidents(stage(batch), read(), gap_seconds, only_newer=False))

    return log.writeStream.foreachBatch(merge)


def incident_stream_to_store(log: DataFrame, store: IncidentStore) -> DataStreamWriter:
    store.ensure()
    return incident_stream(log, store.read, store.replace)


def incident_stream_to_months(log: DataFrame, store: MonthlyIncidents) -> DataStreamWriter:
    """Each micro-batch reads and rewrites only the months that its rows touch."""
    store.ensure()
    return log.writeStream.foreachBatch(lambda batch, _batch_id: store.merge(batch) and None)


class StagedIncidents:
    """Incident state kept as staged files, for a stream without a catalog table."""

    def __init__(self, spark: SparkSession):
        self.current = spark.createDataFrame([], INCIDENT)

    def read(self) -> DataFrame:
        return self.current

    def replace(self, incidents: DataFrame) -> None:
        self.current = stage(incidents)


def _utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def freshness_stream(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    rule: FreshnessRule,
    station: str,
    source_table: str,
    log_table: str,
    clock: Callable[[], datetime] = _utc_now,
    every: str = "5 minutes",
) -> DataStreamWriter:
    """Log the freshness of a table ``every`` so often, whether or not anything arrives.

    A timer drives it: each tick judges the newest time that ``read`` shows by then, so a dead
    feed is reported, and old rows that come after newer ones change nothing. ``log_table`` is
    a :class:`LogParts` table, where each tick has its own rows, once.
    """

    log, stream = LogParts(spark, log_table), f"freshness/{station}/{source_table}"
    log.ensure()

    def check(_tick: DataFrame, batch_id: int) -> None:
        # A tick that is run again after a failure was judged at its own time.
        if log.has(stream, batch_id):
            return
        now = clock()
        log.write(freshness(read(), rule, now, station, source_table, now), stream, batch_id)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(check).trigger(processingTime=every)


def session_approximation(
    log: DataFrame, window_seconds: int, gap_seconds: int = MERGE_GAP_SECONDS, delay: str | None = None
) -> DataFrame:
    """Incident ranges by session window, for logs whose windows all last ``window_seconds``.

    A session measures from window start to window start and lasts one gap beyond the last
    start, which is taken off again. Windows exactly ``gap_seconds`` apart stay separate
    here but belong together in the batch merge. A stream has to say how late rows may be
    (``delay``); it drops later ones.
    """
    failed = log.filter(F.col("status") == "failed")
    if failed.isStreaming and delay is None:
        raise ValueError("a stream needs a delay, after which rows no longer count")
    timed = failed.withWatermark("window_start", delay) if failed.isStreaming else failed
    reach = f"{window_seconds + gap_seconds} seconds"
    return (
        timed.groupBy(*INCIDENT_KEYS, F.session_window("window_start", reach).alias("s"))
        .agg(F.count(F.lit(1)).alias("failed_windows"))
        .select(
            *INCIDENT_KEYS,
            F.col("s.start").alias("incident_start"),
            (F.col("s.end") - F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("incident_end"),
            "failed_windows",
        )
    )
