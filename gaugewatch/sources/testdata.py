"""The benchmark tables in the shapes the operators expect."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewatch.functions.columns import tick
from gaugewatch.schemas import TAG, TS, VALUE
from gaugewatch.session import use_utc

EVENT_TAGS = ["click", "error", "purchase", "signup", "view"]
EVENTS_START, EVENTS_END = datetime(2024, 1, 1), datetime(2024, 1, 31)
LINEITEM_TAGS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as tags, event values as readings."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias(TS), F.col("event_type").alias(TAG), F.col("value").alias(VALUE)
    )


def events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per event type, NULL except for the row's own type."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias(TS),
        *[F.when(F.col("event_type") == tag, F.col("value")).alias(tag) for tag in EVENT_TAGS],
    )


def lineitem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias(TS), *[tick(tag) for tag in LINEITEM_TAGS]
    )
