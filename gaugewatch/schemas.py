"""Table layouts shared by the monitors, the incident store and the reports."""

from __future__ import annotations

from pyspark.sql import types as T

TS = "Pi_Timestamp"
INGEST_TS = "Current_Timestamp"
TAG = "tag_name"
VALUE = "tag_value"

# Tag name of a log row that judges a whole table.
TABLE_TAG = "_table_"

LONG = T.StructType(
    [
        T.StructField(TS, T.TimestampType()),
        T.StructField(TAG, T.StringType()),
        T.StructField(VALUE, T.DoubleType()),
    ]
)

MONITOR_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("station", T.StringType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("tag_name", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("observed_value", T.StringType()),
        T.StructField("create_ts", T.TimestampType()),
    ]
)

INCIDENT = T.StructType(
    [
        T.StructField("incident_id", T.StringType()),
        T.StructField("station", T.StringType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("tag_name", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("incident_start", T.TimestampType()),
        T.StructField("incident_end", T.TimestampType()),
        T.StructField("first_run_id", T.StringType()),
        T.StructField("last_run_id", T.StringType()),
        T.StructField("create_ts", T.TimestampType()),
        T.StructField("update_ts", T.TimestampType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("incident_id", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("create_ts", T.TimestampType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("process_area", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("related_tags", T.ArrayType(T.StringType())),
        T.StructField("kg_node_id", T.StringType()),
    ]
)

# What identifies the thing that failed; incidents never span two of these.
INCIDENT_KEYS = ["station", "source_table", "tag_name", "rule_type", "status"]

# The six outlier measurements kept inside ``observed_value``.
THRESHOLD_FIELDS = [
    "recent_min",
    "recent_max",
    "history_p1",
    "history_p99",
    "lower_threshold",
    "upper_threshold",
]
