"""Session set-up and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def build_session(app_name: str = "gaugewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Times are UTC by convention; local time is only made on request."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application: Python functions run there need them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="gaugewatch-modules-")) / "gaugewatch_modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def local_frame(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A few driver-side rows as a relation whose size the optimizer knows."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gaugewatch-")
    context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and tells the optimizer the true size,
    so a small result is broadcast by the size check of
    ``spark.sql.autoBroadcastJoinThreshold`` and a large one is not.
    """
    path = f"{scratch_dir(df.sparkSession)}/gaugewatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
