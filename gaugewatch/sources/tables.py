"""Tables of the monitor: creation, appends, replacement and layout."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugewatch.config import Settings, incident_window
from gaugewatch.functions.columns import closed, tick
from gaugewatch.functions.noise import add_noise
from gaugewatch.operators.incidents import MERGE_GAP_SECONDS, merge_incidents
from gaugewatch.operators.reshape import history_slice, resolve_tags, wide_to_long
from gaugewatch.operators.runs import to_log
from gaugewatch.schemas import FEEDBACK, INCIDENT, MONITOR_LOG, TAG, TS
from gaugewatch.session import stage


def ensure_table(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """Create the table when it is not there yet."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def ensure_log_table(spark: SparkSession, name: str) -> None:
    ensure_table(spark, name, MONITOR_LOG)


def ensure_feedback_table(spark: SparkSession, name: str) -> None:
    ensure_table(spark, name, FEEDBACK)


def write_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Overwriting replaces the schema too; the table must not be one the plan reads."""
    df.write.mode(mode).saveAsTable(name)


def append_log(judged: DataFrame, name: str) -> None:
    to_log(judged).write.mode("append").saveAsTable(name)


def add_feedback(spark: SparkSession, table: str, incident_id: str, comment: str) -> None:
    """Append one trimmed, non-empty comment with its author and time."""
    comment = comment.strip()
    if not comment:
        raise ValueError("Comment cannot be empty.")
    row = spark.createDataFrame([(incident_id, comment)], "incident_id string, comment string")
    row.select(
        "incident_id", "comment", F.current_user().alias("created_by"), F.current_timestamp().alias("create_ts")
    ).write.mode("append").saveAsTable(table)


class IncidentStore:
    """The incident table as numbered versions behind a view.

    A merge reads the current version and writes the next one in full; the view moves only
    when that is complete, so a lost job leaves the last good version in place.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def _versions(self) -> list[int]:
        # Catalogs lower-case names.
        prefix = self.name.split(".")[-1].lower() + "_v"
        database = self.name.rpartition(".")[0] or None
        names = [table.name.lower() for table in self.spark.catalog.listTables(database)]
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())

    def ensure(self) -> None:
        if not self._versions():
            ensure_table(self.spark, f"{self.name}_v1", INCIDENT)
            self._point_to(1)

    def _point_to(self, version: int) -> None:
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT * FROM {self.name}_v{version}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def replace(self, incidents: DataFrame) -> None:
        versions = self._versions()
        following = (versions[-1] if versions else 0) + 1
        incidents.select(INCIDENT.fieldNames()).write.mode("overwrite").saveAsTable(f"{self.name}_v{following}")
        self._point_to(following)
        for old in versions[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{old}")


#: Writing to such a table replaces the partitions written to, and no other, whatever the session's setting.
_OWN_PARTITIONS = "USING parquet OPTIONS (partitionOverwriteMode 'dynamic')"


class LogParts:
    """Log rows of streams, laid out by stream and batch: writing a batch again replaces its own rows."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def ensure(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MONITOR_LOG.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, stream STRING, batch BIGINT) {_OWN_PARTITIONS} "
            "PARTITIONED BY (stream, batch)"
        )

    def has(self, stream: str, batch: int) -> bool:
        """Whether rows of this batch are there; only its partition is looked at."""
        own = (F.col("stream") == stream) & (F.col("batch") == batch)
        return not self.spark.table(self.name).where(own).isEmpty()

    def write(self, judged: DataFrame, stream: str, batch: int) -> None:
        rows = to_log(judged).withColumns({"stream": F.lit(stream), "batch": F.lit(batch).cast("bigint")})
        rows.write.mode("overwrite").insertInto(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(MONITOR_LOG.fieldNames())

    def read_stream(self, stream: str) -> DataFrame:
        """The rows of one stream; other partitions are not looked at."""
        return self.spark.table(self.name).where(F.col("stream") == stream).select(MONITOR_LOG.fieldNames())


class MonthlyIncidents:
    """The incident table laid out by the months in which incidents start and end.

    A merge reads only the partitions that the new rows can reach, however old the table, and
    rewrites only those in which a row changed. Should it be lost before a partition that has
    become empty is dropped, the next merge joins the same incidents again.
    """

    _MONTHS = ["start_month", "end_month"]

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def ensure(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in INCIDENT.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, start_month STRING, end_month STRING) {_OWN_PARTITIONS} "
            "PARTITIONED BY (start_month, end_month)"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(INCIDENT.fieldNames())

    def _with_months(self, incidents: DataFrame) -> DataFrame:
        month = lambda ts: F.date_format(ts, "yyyy-MM")
        rows = incidents.select(INCIDENT.fieldNames())
        return rows.withColumns({"start_month": month("incident_start"), "end_month": month("incident_end")})

    def reached(self, rows: DataFrame, gap_seconds: int = MERGE_GAP_SECONDS) -> DataFrame:
        """Stored incidents of the months that the log rows, and the gap around them, touch."""
        gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
        month = lambda ts: F.date_format(ts, "yyyy-MM")
        first, last = rows.agg(month(F.min("window_start") - gap), month(F.max("window_end") + gap)).first()
        touched = (F.col("end_month") >= F.lit(first)) & (F.col("start_month") <= F.lit(last))
        return self.spark.table(self.name).where(F.coalesce(touched, F.lit(False)))

    def merge(self, rows: DataFrame, gap_seconds: int = MERGE_GAP_SECONDS) -> list[tuple[str, str]]:
        """Merge the failed ones of some log rows, each given once or again; returns the partitions rewritten."""
        rows = stage(rows.where(F.col("status") == "failed"))
        if rows.isEmpty():
            return []
        old = stage(self.reached(rows, gap_seconds))
        merged = merge_incidents(rows, old.select(INCIDENT.fieldNames()), gap_seconds, only_newer=False)
        new = stage(self._with_months(merged).select(old.columns))
        # A handful of months: those of the rows that came or went.
        changed = new.exceptAll(old).union(old.exceptAll(new)).select(*self._MONTHS).distinct()
        months = [tuple(r) for r in changed.collect()]
        kept = new.join(F.broadcast(changed), self._MONTHS, "left_semi").select(old.columns)
        kept.write.mode("overwrite").insertInto(self.name)
        filled = {tuple(r) for r in kept.select(*self._MONTHS).distinct().collect()}
        for start, end in set(months) - filled:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (start_month='{start}', end_month='{end}')")
        return sorted(months)


def describe_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Columns and types in order."""
    return [(field.name, field.dataType.simpleString()) for field in df.schema.fields]


def create_history_tables(spark: SparkSession, settings: Settings) -> None:
    """Base table of the history range, and its noisy twin."""
    base = history_slice(spark.table(settings.source_table), settings.history_start, settings.history_end)
    write_table(base, settings.base_table)
    write_table(
        add_noise(spark.table(settings.base_table), settings.noise_rate, settings.noise_seed), settings.noisy_table
    )


def lay_out_long(long: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ranges of tag and time, sorted inside, so files carry tight min/max statistics.

    A large tag spreads over many ranges of its time.
    """
    columns = [TAG, TS]
    ranged = long.repartitionByRange(partitions, *columns) if partitions else long.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)


def rebuild_long_table(spark: SparkSession, source: str, target: str, wanted) -> DataFrame:
    """Drop and rebuild the long table; returns the wanted tags that the source lacks."""
    wide = spark.table(source)
    (ts,), _ = resolve_tags(wide.columns, [TS])
    found, missing = resolve_tags(wide.columns, wanted)
    spark.sql(f"DROP TABLE IF EXISTS {target}")
    write_table(lay_out_long(wide_to_long(wide, found, ts)), target)
    return spark.createDataFrame([(tag,) for tag in missing], "missing_tag string")


def incident_history(wide: DataFrame, tag: str, start: datetime, end: datetime) -> DataFrame:
    """Readings of one tag from an hour before an incident to an hour after it."""
    if start >= end:
        raise ValueError("Start time must be before end time.")
    window = incident_window(start, end)
    return wide.select(TS, tick(tag)).filter(closed(F.col(TS), *window)).orderBy(TS)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)
