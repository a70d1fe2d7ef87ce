"""Feed records that cannot be read as they should: told apart, with reasons, and kept as a table.

A record is loaded if it is JSON and its time parses. A measurement that is no number becomes
NULL in a loaded record. Both are reported, so every value that the feed lost can be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from gaugewatch.schemas import INGEST_TS, TS
from gaugewatch.session import stage
from gaugewatch.sources.readings import (
    FEED_TS,
    FEED_TS_FORMAT,
    STATION_FIELDS,
    feed_schema,
    feed_value,
    json_files,
    mapped_columns,
    require_rows,
    settled,
)

CORRUPT = "_corrupt_record"
SOURCE_FILE, RECORD, PROBLEMS, LOADED = "source_file", "record", "problems", "loaded"
REJECTS = [SOURCE_FILE, RECORD, PROBLEMS, LOADED, INGEST_TS]

NOT_JSON, NO_TIME, BAD_TIME, NOT_A_NUMBER = "not JSON", "no time", "not a time", "not a number"


def read_feed(
    reader, directory: str, fields: dict[str, str] = STATION_FIELDS, lines: bool = False, names: str = "*.json"
) -> DataFrame:
    """All fields as text, with the text of records that are no JSON and the file of each record.

    ``reader`` is ``spark.read`` or ``spark.readStream``. With ``lines`` each line is a record and large
    files are split; else a file is one document or array, and is rejected whole.
    """
    schema = feed_schema(fields).add(CORRUPT, T.StringType())
    reader = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    found = json_files(reader, directory, lines, names)
    return settled(found.withColumn(SOURCE_FILE, F.col("_metadata.file_path")), fields)


def problems(raw: DataFrame, fields: dict[str, str] = STATION_FIELDS, ts_format: str = FEED_TS_FORMAT) -> Column:
    """What is wrong with each record, in the order of the fields: (field, reason, found); empty if nothing is."""
    corrupt = F.col(CORRUPT) if CORRUPT in raw.columns else F.lit(None).cast("string")
    whole = corrupt.isNull()

    def problem(field: str | None, reason: str, found: Column) -> Column:
        name = F.lit(field).cast("string").alias("field")
        return F.struct(name, F.lit(reason).alias("reason"), found.cast("string").alias("found"))

    stamp = feed_value(raw, FEED_TS, TS).cast("string")
    parsed = F.try_to_timestamp(stamp, F.lit(ts_format))
    checks = [
        F.when(~whole, problem(None, NOT_JSON, F.lit(None))),
        F.when(whole & stamp.isNull(), problem(TS, NO_TIME, F.lit(None))),
        F.when(whole & stamp.isNotNull() & parsed.isNull(), problem(TS, BAD_TIME, stamp)),
    ]
    for old, new in fields.items():
        text = feed_value(raw, old, new).cast("string")
        checks.append(F.when(whole & text.isNotNull() & text.try_cast("double").isNull(), problem(new, NOT_A_NUMBER, text)))
    return F.filter(F.array(*checks), lambda found: found.isNotNull())


def examine(raw: DataFrame, fields: dict[str, str] = STATION_FIELDS, ts_format: str = FEED_TS_FORMAT) -> DataFrame:
    """The mapped columns of every record, with source_file, record, problems and loaded.

    ``record`` holds the fields of records with problems as JSON, or the text that is none.
    Columns of these names in ``raw`` give way; no record is left out.
    """
    own = [c for c in raw.columns if c not in {CORRUPT, *REJECTS}]
    shown = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]))
    if CORRUPT in raw.columns:
        shown = F.coalesce(F.col(CORRUPT), shown)
    source = F.col(SOURCE_FILE) if SOURCE_FILE in raw.columns else F.lit(None).cast("string")
    fatal = F.exists(PROBLEMS, lambda p: p["reason"].isin(NOT_JSON, NO_TIME, BAD_TIME))
    examined = raw.select(
        *mapped_columns(raw, fields, ts_format),
        source.alias(SOURCE_FILE),
        shown.alias(RECORD),
        problems(raw, fields, ts_format).alias(PROBLEMS),
    )
    return examined.withColumn(RECORD, F.when(F.size(PROBLEMS) > 0, F.col(RECORD))).withColumn(LOADED, ~fatal)


def loaded(examined: DataFrame) -> DataFrame:
    """The rows of the wide table."""
    return examined.where(LOADED).drop(SOURCE_FILE, RECORD, PROBLEMS, LOADED)


def rejects(examined: DataFrame) -> DataFrame:
    """Records with problems, whether or not they were loaded."""
    return examined.where(F.size(PROBLEMS) > 0).select(*REJECTS)


def load_with_rejects(
    spark: SparkSession,
    directory: str,
    table: str,
    rejects_table: str,
    mode: str = "overwrite",
    fields: dict[str, str] = STATION_FIELDS,
    lines: bool = False,
) -> None:
    """Load a directory of JSON readings; records with problems go to a table of their own.

    The files are parsed once. A directory without records raises ValueError, and neither table changes.
    """
    how = mode.strip().lower()
    if not table.strip() or not rejects_table.strip() or how not in {"append", "overwrite"}:
        raise ValueError(f"cannot load into {table!r} and {rejects_table!r} by {mode!r}")
    examined = stage(examine(read_feed(spark.read, directory, fields, lines), fields))
    require_rows(examined, directory)
    loaded(examined).write.mode(how).saveAsTable(table.strip())
    rejects(examined).write.mode(how).saveAsTable(rejects_table.strip())


class QuarantineStream:
    """Files of readings as they arrive, each micro-batch parted into loaded rows and rejects.

    A batch has folders of its own number under ``folder``, so a replayed batch writes the same ones.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, str] = STATION_FIELDS, lines: bool = False):
        self.spark, self.folder, self.fields, self.lines = spark, folder, fields, lines
        names = [*fields, FEED_TS]
        empty = spark.createDataFrame([], ", ".join(f"`{name}` string" for name in names))
        self._write(examine(empty, fields), -1)

    def _write(self, examined: DataFrame, batch_id: int) -> None:
        loaded(examined).write.mode("overwrite").parquet(f"{self.folder}/loaded/batch={batch_id}")
        rejects(examined).write.mode("overwrite").parquet(f"{self.folder}/rejects/batch={batch_id}")

    def keep(self, batch: DataFrame, batch_id: int) -> None:
        self._write(stage(examine(batch, self.fields)), batch_id)

    def writer(self, directory: str) -> DataStreamWriter:
        arriving = read_feed(self.spark.readStream, directory, self.fields, self.lines)
        return arriving.writeStream.foreachBatch(self.keep)

    def loaded(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/loaded")

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rejects")
