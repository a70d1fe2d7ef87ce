"""What several operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import gaugewatch
from gaugewatch.session import scratch_dir, use_utc

__all__ = ["ascii_lower", "bucket_of", "only", "row_key", "ship", "stage", "table"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(gaugewatch.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="gaugewatch-modules-")) / "gaugewatch_modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back, so that its size is known.

    The shuffle files behind it go as soon as it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(id_column: str, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``; null for a null identifier."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def row_key(columns: list[str]) -> Column:
    """SHA-256 of a row's ``columns``, nulls told from values: equal rows only have equal keys, and it is never null."""
    shown = [F.col(c).cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]
    return F.sha2(F.concat_ws(",", *told), 256)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in the staged, distinct column ``key`` of ``ids``.

    Staged identifiers have a known size, by which the optimizer sends them to the rows
    (``spark.sql.autoBroadcastJoinThreshold``), so long texts stay where they are, or shuffles both.
    """
    return rows.join(ids.select(key), key, "left_semi")
