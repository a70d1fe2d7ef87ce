"""The evidence checks as SQL functions that return JSON text.

They are meant for one interactive request over a bounded window; the typed operators in
:mod:`gaugewatch.operators.evidence` are for everything larger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from gaugewatch.functions.columns import LOCAL_ZONE
from gaugewatch.operators.evidence import MAX_SAMPLE_POINTS
from gaugewatch.schemas import TAG, TS, VALUE

_TAGS = "tag_names ARRAY<STRING>"
_WINDOW = f"{_TAGS}, start_ts TIMESTAMP, end_ts TIMESTAMP"


@dataclass(frozen=True)
class EvidenceTables:
    """The tables that the functions read, and how many raw points of a tag an answer shows."""

    long: str = "incident_tag_values"
    incidents: str = "monitor_incident"
    log: str = "monitor_log"
    feedback: str = "monitor_incident_feedback"
    max_points: int = MAX_SAMPLE_POINTS


def _fields(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _utc(ts: str) -> str:
    return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')"


def _nzt(ts: str) -> str:
    return _utc(f"from_utc_timestamp({ts}, '{LOCAL_ZONE}')")


def _rows(query: str, **fields: str) -> str:
    """Sorted array of the query's rows, as a scalar subquery."""
    return f"(SELECT array_sort(collect_list({_fields(**fields)})) FROM ({query}))"


def _key(name: str) -> str:
    return f"regexp_replace(trim(lower({name})), '[^a-z0-9]+', '_')"


def _answer(check: str, source: str, request: str, **content: str) -> str:
    return "SELECT to_json(" + _fields(
        status="'executed'", check_type=f"'{check}'", source_table=f"'{source}'", input=request, **content
    ) + ")"


def _points(long: str, start: str = "start_ts", end: str = "end_ts") -> str:
    return (
        f"SELECT {TAG}, {TS}, {VALUE} FROM {long} "
        f"WHERE array_contains(tag_names, {TAG}) AND {TS} >= {start} AND {TS} < {end}"
    )


def _catalog(t: EvidenceTables) -> str:
    per_tag = f"SELECT {TAG}, min({TS}) AS first_ts, max({TS}) AS last_ts FROM {t.long} GROUP BY {TAG}"
    return "SELECT to_json(" + _fields(
        status="'executed'",
        source_table=f"'{t.long}'",
        timestamp_col=f"'{TS}'",
        tag_count=f"count({TAG})",
        tags=f"array_sort(collect_list({TAG}))",
        min_ts_utc=_utc("min(first_ts)"),
        max_ts_utc=_utc("max(last_ts)"),
    ) + f") FROM ({per_tag})"


def _packet(t: EvidenceTables) -> str:
    keys = ["station", "source_table", TAG, "rule_type", "status"]
    # The last version, should an identifier stand there more than once.
    newest = f"SELECT max_by(struct(*), update_ts) AS i FROM {t.incidents} WHERE incident_id = wanted_id"
    incident = f"SELECT i.* FROM ({newest}) WHERE i IS NOT NULL"
    same = " AND ".join(f"l.{key} = i.{key}" for key in keys)
    logs = (
        f"SELECT l.* FROM {t.log} l JOIN ({incident}) i ON {same} "
        "AND l.window_start <= i.incident_end AND l.window_end >= i.incident_start"
    )
    plain = {key: key for key in keys}
    header = _fields(
        incident_id="incident_id", **plain,
        incident_start_utc=_utc("incident_start"), incident_end_utc=_utc("incident_end"),
        first_run_id="first_run_id", last_run_id="last_run_id",
        create_ts_utc=_utc("create_ts"), update_ts_utc=_utc("update_ts"),
    )
    found = f"(SELECT {header} FROM ({incident}))"
    log_rows = _rows(
        logs, run_id="run_id", station="station", source_table="source_table", tag_name=TAG, rule_type="rule_type",
        window_start_utc=_utc("window_start"), window_end_utc=_utc("window_end"), status="status",
        observed_value="observed_value", create_ts_utc=_utc("create_ts"),
    )
    notes = _rows(
        f"SELECT * FROM {t.feedback} WHERE incident_id = wanted_id",
        comment="comment", created_by="created_by", create_ts_utc=_utc("create_ts"),
    )
    return "SELECT to_json(" + _fields(
        status=f"CASE WHEN (SELECT count(*) FROM ({incident})) = 0 THEN 'not_found' ELSE 'executed' END",
        incident_id="wanted_id",
        source_tables=f"array('{t.incidents}', '{t.log}', '{t.feedback}')",
        incident=found,
        quality_log_rows=log_rows,
        feedback_rows=notes,
    ) + ")"


_WINDOW_INPUT = _fields(tag_names="tag_names", start_ts_utc=_utc("start_ts"), end_ts_utc=_utc("end_ts"))


def _sample(t: EvidenceTables) -> str:
    points = _points(t.long)
    first = (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {TAG} ORDER BY {TS}, {VALUE}) AS place "
        f"FROM ({points})) WHERE place <= {t.max_points}"
    )
    totals = f"SELECT {TAG}, count(*) AS total FROM ({points}) GROUP BY {TAG}"
    return _answer(
        "raw_points_sample", t.long, _WINDOW_INPUT,
        max_points_per_tag=str(t.max_points),
        total_points_by_tag=_rows(totals, tag_name=TAG, total_points="total"),
        returned_points=f"(SELECT coalesce(sum(least(total, {t.max_points})), 0) FROM ({totals}))",
        points=_rows(first, tag_name=TAG, ts_utc=_utc(TS), value=VALUE),
    )


def _extent(first: str = "first_ts", last: str = "last_ts") -> dict[str, str]:
    return {"first_ts_utc": _utc(first), "last_ts_utc": _utc(last)}


def _window_stats(t: EvidenceTables) -> str:
    # Exact quartiles, by the places of the readings in their order.
    placed = (
        f"SELECT *, row_number() OVER (PARTITION BY {TAG} ORDER BY {VALUE} NULLS LAST) AS place, "
        f"count({VALUE}) OVER (PARTITION BY {TAG}) AS filled FROM ({_points(t.long)})"
    )
    quartiles = ", ".join(
        f"min(CASE WHEN place >= greatest(ceil({share}D * filled), 1) THEN {VALUE} END)" for share in (0.25, 0.5, 0.75)
    )
    stats = (
        f"SELECT {TAG}, count(*) AS points, min({TS}) AS first_ts, max({TS}) AS last_ts, min({VALUE}) AS low, "
        f"array({quartiles}) AS q, avg({VALUE}) AS mean, max({VALUE}) AS high, stddev_samp({VALUE}) AS spread "
        f"FROM ({placed}) GROUP BY {TAG}"
    )
    return _answer(
        "related_tag_window_stats", t.long, _WINDOW_INPUT,
        stats=_rows(
            stats, tag_name=TAG, point_count="points", **_extent(), min_value="low", p25_value="q[0]",
            avg_value="mean", median_value="q[1]", p75_value="q[2]", max_value="high", stddev_value="spread",
        ),
    )


def _phases(t: EvidenceTables) -> str:
    phase = (
        f"CASE WHEN {TS} < incident_start_ts THEN 'before' WHEN {TS} < incident_end_ts THEN 'during' ELSE 'after' END"
    )
    stats = (
        f"SELECT {TAG}, phase, count(*) AS points, min({TS}) AS first_ts, max({TS}) AS last_ts, min({VALUE}) AS low, "
        f"avg({VALUE}) AS mean, max({VALUE}) AS high, stddev_samp({VALUE}) AS spread "
        f"FROM (SELECT *, {phase} AS phase FROM ({_points(t.long, 'before_start_ts', 'after_end_ts')})) "
        f"GROUP BY {TAG}, phase"
    )
    bounds = ["before_start_ts", "incident_start_ts", "incident_end_ts", "after_end_ts"]
    request = _fields(tag_names="tag_names", **{f"{b}_utc": _utc(b) for b in bounds})
    return _answer(
        "before_during_after_stats", t.long, request,
        stats=_rows(
            stats, tag_name=TAG, window_phase="phase", point_count="points", **_extent(), min_value="low",
            avg_value="mean", max_value="high", stddev_value="spread",
        ),
    )


def _gaps(t: EvidenceTables) -> str:
    # Seconds first, then gaps within a day, then from day to day: no window over a whole tag.
    seconds = (
        f"SELECT {TAG}, unix_seconds({TS}) AS s, count(*) AS n, count({VALUE}) AS filled, min({TS}) AS first_ts, "
        f"max({TS}) AS last_ts FROM ({_points(t.long)}) GROUP BY 1, 2"
    )
    within = f"SELECT *, s - lag(s) OVER (PARTITION BY {TAG}, s DIV 86400 ORDER BY s) AS gap FROM ({seconds})"
    days = (
        f"SELECT {TAG}, s DIV 86400 AS day, sum(n) AS n, sum(filled) AS filled, min(first_ts) AS first_ts, "
        f"max(last_ts) AS last_ts, min(s) AS first_s, max(s) AS last_s, sum(gap) AS gap_sum, "
        f"max(greatest(gap, if(n > 1, 0, NULL))) AS gap_max, count_if(gap > 300) AS over_5m, "
        f"count_if(gap > 900) AS over_15m FROM ({within}) GROUP BY 1, 2"
    )
    steps = f"SELECT *, first_s - lag(last_s) OVER (PARTITION BY {TAG} ORDER BY day) AS step FROM ({days})"
    stats = (
        f"SELECT {TAG}, sum(filled) AS points, min(first_ts) AS first_ts, max(last_ts) AS last_ts, "
        f"max(greatest(gap_max, step)) AS longest, "
        f"try_divide(coalesce(sum(gap_sum), 0) + coalesce(sum(step), 0), sum(n) - 1) AS mean, "
        f"sum(over_5m) + count_if(step > 300) AS over_5m, sum(over_15m) + count_if(step > 900) AS over_15m "
        f"FROM ({steps}) GROUP BY {TAG}"
    )
    return _answer(
        "missingness_gap_profile", t.long, _WINDOW_INPUT,
        stats=_rows(
            stats, tag_name=TAG, point_count="points", **_extent(), max_gap_seconds="longest",
            avg_gap_seconds="mean", gaps_over_5m="over_5m", gaps_over_15m="over_15m",
        ),
    )


def _thresholds(t: EvidenceTables) -> str:
    asked = (
        f"SELECT {_key('name')} AS tag_key, min_by(name, place) AS requested "
        "FROM (SELECT posexplode(tag_names) AS (place, name)) GROUP BY 1"
    )
    known = (
        f"SELECT {_key(TAG)} AS tag_key, min({TAG}) AS matched, sum(n) AS points, min(first_ts) AS first_ts, "
        f"max(last_ts) AS last_ts FROM (SELECT {TAG}, count(*) AS n, min({TS}) AS first_ts, max({TS}) AS last_ts "
        f"FROM {t.long} GROUP BY {TAG}) GROUP BY 1"
    )
    # The limits become columns first: an aggregate may not mix columns and arguments.
    judged = (
        f"SELECT p.*, requested, lower_threshold AS lower_limit, upper_threshold AS upper_limit "
        f"FROM {t.long} p JOIN ({asked}) a ON {_key('p.' + TAG)} = a.tag_key "
        f"WHERE {TS} >= start_ts AND {TS} < end_ts"
    )
    stats = (
        f"SELECT requested, {TAG}, count(*) AS points, min({TS}) AS first_ts, max({TS}) AS last_ts, "
        f"min({VALUE}) AS low, avg({VALUE}) AS mean, max({VALUE}) AS high, "
        f"min(lower_limit) AS lower_limit, max(upper_limit) AS upper_limit, "
        f"count_if({VALUE} < lower_limit) AS below, count_if({VALUE} > upper_limit) AS above "
        f"FROM ({judged}) GROUP BY requested, {TAG}"
    )
    request = _fields(
        tag_names="tag_names", start_ts_utc=_utc("start_ts"), end_ts_utc=_utc("end_ts"),
        start_ts_nzt=_nzt("start_ts"), end_ts_nzt=_nzt("end_ts"),
        lower_threshold="lower_threshold", upper_threshold="upper_threshold",
    )
    return _answer(
        "outlier_threshold_context", t.long, request,
        tag_matches=_rows(
            f"SELECT * FROM ({known}) JOIN ({asked}) USING (tag_key)",
            requested_tag="requested", matched_tag="matched", catalog_point_count="points",
            catalog_min_ts_utc=_utc("first_ts"), catalog_max_ts_utc=_utc("last_ts"),
        ),
        stats=_rows(
            stats, requested_tag="requested", tag_name=TAG, matched_tag=TAG, point_count="points", **_extent(),
            first_ts_nzt=_nzt("first_ts"), last_ts_nzt=_nzt("last_ts"), min_value="low", avg_value="mean",
            max_value="high", lower_threshold="lower_limit", upper_threshold="upper_limit",
            below_lower_threshold_count="below", above_upper_threshold_count="above",
        ),
    )


_FUNCTIONS = {
    "get_app_tag_catalog": ("", _catalog),
    "get_incident_packet": ("wanted_id STRING", _packet),
    "get_raw_points_sample": (_WINDOW, _sample),
    "get_related_tag_window_stats": (_WINDOW, _window_stats),
    "get_before_during_after_stats": (
        f"{_TAGS}, before_start_ts TIMESTAMP, incident_start_ts TIMESTAMP, "
        "incident_end_ts TIMESTAMP, after_end_ts TIMESTAMP",
        _phases,
    ),
    "get_missingness_gap_profile": (_WINDOW, _gaps),
    "get_outlier_threshold_context": (f"{_WINDOW}, lower_threshold DOUBLE, upper_threshold DOUBLE", _thresholds),
}


def register_functions(
    spark: SparkSession, tables: EvidenceTables = EvidenceTables(), temporary: bool = True
) -> list[str]:
    """Create the seven functions over the given tables or views; returns their names."""
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    for name, (arguments, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE {kind} {name}({arguments}) RETURNS STRING RETURN {body(tables)}")
    return list(_FUNCTIONS)
