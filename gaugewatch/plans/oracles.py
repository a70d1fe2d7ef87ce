"""The check queries once more, as plain SQL for another engine over the same tables."""

from __future__ import annotations

from gaugewatch.plans.demo import EVENT_PERIODS, LINEITEM_PERIODS, PHASES, REQUESTED, RUN_AT, SPLIT_AT, WINDOW

_KEYS = "station, source_table, tag_name, rule_type, status"
_TAGS = "(VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS t(tag_name)"
_LONG = "long AS (SELECT ts AS Pi_Timestamp, event_type AS tag_name, value AS tag_value FROM events)"
_WIDE = """wide AS (SELECT ts AS Pi_Timestamp,
  CASE WHEN event_type = 'click' THEN value END AS click,
  CASE WHEN event_type = 'error' THEN value END AS error,
  CASE WHEN event_type = 'purchase' THEN value END AS purchase,
  CASE WHEN event_type = 'signup' THEN value END AS signup,
  CASE WHEN event_type = 'view' THEN value END AS "view" FROM events)"""
_EVENT_READINGS = f"""{_WIDE},
readings AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (tag_value FOR tag_name IN (click, error, purchase, signup, "view")))"""
_ITEM_READINGS = """readings AS (SELECT l_shipdate AS Pi_Timestamp, tag_name, tag_value FROM
  (SELECT l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  UNPIVOT INCLUDE NULLS (tag_value FOR tag_name IN (l_quantity, l_extendedprice, l_discount, l_tax)))"""


_FLOWS = """flows AS (SELECT l_orderkey, l_linenumber, l_quantity AS steam, l_tax * 100 AS supply, l_discount * 300 AS brine,
  l_extendedprice / 100 AS reinjected, l_quantity * 2 AS lp_steam, l_quantity * 3 AS turbine, l_quantity / 5 AS hp_in,
  l_discount * 50 + 1 AS lp_in, l_tax + 0.05::DOUBLE AS condenser FROM lineitem)"""


def _grid(lookback: int, tags: str = _TAGS) -> str:
    return f"""grid AS (SELECT tag_name, run_no,
  TIMESTAMP '2024-01-01' + to_hours(run_no) AS window_end,
  TIMESTAMP '2024-01-01' + to_hours(run_no) - INTERVAL {lookback} MINUTE AS window_start
  FROM {tags}, range(1, 721) AS r(run_no))"""


_RUN_ID = "'demo station__' || strftime({ts}, '%Y%m%d_%H%M%S')"


def _stuck(name: str, lookback: int, least: int, widest: float, zero: str) -> str:
    """Grid must be there; result columns follow the rule's."""
    kept = f"CASE WHEN l.tag_name IN ({zero}) AND l.tag_value = 0 THEN NULL ELSE l.tag_value END"
    return f"""{name} AS (SELECT *, CASE WHEN range_value IS NULL THEN 'skipped'
    WHEN range_value <= {widest} THEN 'failed' ELSE 'pass' END AS status FROM (
  SELECT *, CASE WHEN valid_count >= {least} THEN max_value - min_value END AS range_value FROM (
  SELECT g.tag_name, g.run_no, g.window_start, g.window_end, count({kept}) AS valid_count,
    min({kept}) AS min_value, max({kept}) AS max_value
  FROM grid g LEFT JOIN long l ON l.tag_name = g.tag_name
    AND l.Pi_Timestamp >= g.window_start AND l.Pi_Timestamp < g.window_end GROUP BY ALL)))"""


def _history(days: int) -> str:
    """quartiles -> fences -> fenced p1 / p99 of each run's history; needs grid."""
    return f"""pairs AS (SELECT g.tag_name, g.run_no, l.tag_value FROM grid g JOIN long l ON l.tag_name = g.tag_name
    AND l.Pi_Timestamp >= g.window_start - INTERVAL {days} DAY AND l.Pi_Timestamp < g.window_start),
  quartiles AS (SELECT tag_name, run_no, count(*) AS history_count,
    quantile_disc(tag_value, 0.25) AS history_q1, quantile_disc(tag_value, 0.75) AS history_q3 FROM pairs GROUP BY ALL),
  fences AS (SELECT *, history_q1 - (history_q3 - history_q1) * 1.5 AS lower_fence,
    history_q3 + (history_q3 - history_q1) * 1.5 AS upper_fence FROM quartiles),
  tails AS (SELECT p.tag_name, p.run_no, quantile_disc(p.tag_value, 0.01) AS history_p1,
    quantile_disc(p.tag_value, 0.99) AS history_p99
    FROM pairs p JOIN fences f ON f.tag_name = p.tag_name AND f.run_no = p.run_no
    WHERE p.tag_value BETWEEN f.lower_fence AND f.upper_fence GROUP BY ALL)"""


def _judged(name: str) -> str:
    """needs grid, long and tails."""
    return f"""recent AS (SELECT g.tag_name, g.run_no, min(tag_value) AS recent_min, max(tag_value) AS recent_max
    FROM grid g JOIN long l ON l.tag_name = g.tag_name
    AND l.Pi_Timestamp >= g.window_start AND l.Pi_Timestamp < g.window_end GROUP BY ALL),
  limits AS (SELECT g.*, recent_min, recent_max, history_p1, history_p99,
    CASE WHEN recent_min IS NOT NULL AND history_p1 IS NOT NULL
      THEN history_p1 - abs(history_p1) * 0.5 END AS lower_threshold,
    CASE WHEN recent_min IS NOT NULL AND history_p1 IS NOT NULL THEN history_p99 * 1.5 END AS upper_threshold
    FROM grid g LEFT JOIN recent r ON r.tag_name = g.tag_name AND r.run_no = g.run_no
    LEFT JOIN tails t ON t.tag_name = g.tag_name AND t.run_no = g.run_no),
  {name} AS (SELECT *, CASE WHEN lower_threshold IS NULL THEN 'skipped'
    WHEN recent_max > upper_threshold OR recent_min < lower_threshold THEN 'failed' ELSE 'pass' END AS status
    FROM limits)"""


_LIMITS = "recent_min, recent_max, history_p1, history_p99, lower_threshold, upper_threshold"
_ZERO = "'purchase', 'view'"
_LOG = f"""{_LONG}, {_grid(60)}, {_stuck("stuck", 60, 3, 40.0, _ZERO)}, {_history(7)}, {_judged("wild")},
log AS (
  SELECT {_RUN_ID.format(ts="window_end")} AS run_id, 'demo station' AS station, 'events' AS source_table, tag_name,
    'stuck_value' AS rule_type, window_start, window_end, status, window_end AS create_ts,
    valid_count, min_value, max_value, range_value,
    NULL::DOUBLE AS recent_min, NULL::DOUBLE AS recent_max, NULL::DOUBLE AS history_p1, NULL::DOUBLE AS history_p99,
    NULL::DOUBLE AS lower_threshold, NULL::DOUBLE AS upper_threshold FROM stuck
  UNION ALL
  SELECT {_RUN_ID.format(ts="window_end")}, 'demo station', 'events', tag_name,
    'outlier', window_start, window_end, status, window_end, NULL, NULL, NULL, NULL, {_LIMITS} FROM wild)"""
_LOG_COLUMNS = "run_id, station, source_table, tag_name, rule_type, window_start, window_end, status, create_ts"


def _incidents(gap: int = 60) -> str:
    order = f"PARTITION BY {_KEYS} ORDER BY window_start, window_end"
    return f"""reach AS (SELECT *, max(window_end) OVER ({order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM log WHERE status = 'failed'),
  chained AS (SELECT *, sum(CASE WHEN reach >= window_start - INTERVAL {gap} SECOND THEN 0 ELSE 1 END)
    OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain FROM reach),
  ranges AS (SELECT {_KEYS}, min(window_start) AS incident_start, max(window_end) AS incident_end,
    min(run_id) AS first_run_id, max(run_id) AS last_run_id, min(create_ts) AS create_ts,
    max(create_ts) AS update_ts FROM chained GROUP BY {_KEYS}, chain),
  incident AS (SELECT sha256(concat_ws('|', {_KEYS}, epoch_us(incident_start)::VARCHAR)) AS incident_id, * FROM ranges)"""


_INCIDENTS = f"{_LOG}, {_incidents()}"
_FEEDBACK = f"""{_INCIDENTS},
feedback AS (SELECT incident_id, 'note ' || i AS comment, update_ts + to_days(i::INTEGER) AS create_ts
  FROM incident, range(1, 3) AS r(i)
  WHERE i <= CASE WHEN incident_id[1] < '4' THEN 2 WHEN incident_id[1] < '8' THEN 1 ELSE 0 END),
notes AS (SELECT incident_id, count(*) AS feedback_count, max(create_ts) AS latest_feedback_ts
  FROM feedback GROUP BY incident_id)"""
_MATCHED = """matched AS (SELECT i.incident_id, i.incident_start, i.incident_end, l.* EXCLUDE (station, source_table, status)
  FROM incident i JOIN log l ON l.station = i.station AND l.source_table = i.source_table AND l.tag_name = i.tag_name
  AND l.rule_type = i.rule_type AND l.status = i.status
  AND l.window_start <= i.incident_end AND l.window_end >= i.incident_start)"""
_RECENT = f"""{_FEEDBACK}, {_MATCHED},
recent_rows AS (SELECT i.incident_id, i.station, i.source_table, i.tag_name, i.rule_type, i.status, i.incident_start,
  i.incident_end, i.first_run_id, i.last_run_id, i.create_ts AS incident_create_ts, i.update_ts AS incident_update_ts,
  m.run_id AS log_run_id, m.window_start, m.window_end, m.create_ts AS log_create_ts,
  n.feedback_count, n.latest_feedback_ts
  FROM incident i LEFT JOIN matched m USING (incident_id) LEFT JOIN notes n USING (incident_id))"""
_SUMMARY = f"""{_RECENT},
summary AS (SELECT incident_id, tag_name, rule_type, status, incident_start, incident_end, incident_update_ts,
  count(log_run_id) AS failed_windows, coalesce(max(feedback_count), 0) AS feedback_count,
  max(latest_feedback_ts) AS latest_feedback_ts,
  CASE WHEN coalesce(max(feedback_count), 0) > 0 THEN 'Commented' ELSE 'Open' END AS review_status,
  (epoch_us(incident_end) - epoch_us(incident_start)) / 6e7 AS duration_minutes
  FROM recent_rows GROUP BY ALL)"""


def _period(name: str, bounds) -> str:
    return f"Pi_Timestamp BETWEEN TIMESTAMP '{bounds[0]}' AND TIMESTAMP '{bounds[1]}'"


def _stats(periods, tags: str, digits: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT *, '{name}' AS period FROM readings WHERE {_period(name, bounds)}" for name, bounds in periods.items()
    )
    return f"""timed AS ({parts}),
expected AS (SELECT tag_name, period FROM {tags}, (VALUES ('baseline'), ('recent')) AS p(period)),
stats AS (SELECT tag_name, period, count(r.Pi_Timestamp) AS row_count, count(tag_value) AS non_null_count,
  count(r.Pi_Timestamp) - count(tag_value) AS null_count,
  CASE WHEN count(r.Pi_Timestamp) > 0
    THEN round((count(r.Pi_Timestamp) - count(tag_value)) / count(r.Pi_Timestamp), {digits}) END AS null_rate,
  round(avg(tag_value), {digits}) AS mean_value, round(stddev_samp(tag_value), {digits}) AS stddev_value,
  min(tag_value) AS min_value, max(tag_value) AS max_value,
  quantile_disc(tag_value, 0.01) AS p1, quantile_disc(tag_value, 0.05) AS p5, quantile_disc(tag_value, 0.5) AS p50,
  quantile_disc(tag_value, 0.95) AS p95, quantile_disc(tag_value, 0.99) AS p99
  FROM expected e LEFT JOIN timed r USING (tag_name, period) GROUP BY tag_name, period)"""


_EVENT_STATS = f"{_EVENT_READINGS}, {_stats(EVENT_PERIODS, _TAGS, 8)}"
_ITEM_TAGS = "(VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('absent')) AS t(tag_name)"
# All events lie in January, when Auckland is 13 hours ahead.
_TREND = f"""{_EVENT_READINGS},
trend AS (SELECT tag_name, date_trunc('day', Pi_Timestamp + INTERVAL 13 HOUR)::TIMESTAMP AS profile_date,
  count(*) AS row_count, count(tag_value) AS non_null_count, count(*) - count(tag_value) AS null_count,
  round((count(*) - count(tag_value)) / count(*), 8) AS null_rate, quantile_disc(tag_value, 0.01) AS p1,
  quantile_disc(tag_value, 0.5) AS p50, quantile_disc(tag_value, 0.99) AS p99
  FROM readings WHERE {_period("baseline", EVENT_PERIODS["baseline"])} GROUP BY ALL)"""
_HISTOGRAM = f"""{_EVENT_READINGS},
kept AS (SELECT * FROM readings WHERE tag_value IS NOT NULL AND {_period("baseline", EVENT_PERIODS["baseline"])}),
spans AS (SELECT tag_name, min(tag_value) AS low, max(tag_value) AS high FROM kept GROUP BY tag_name),
binned AS (SELECT k.tag_name, low, high, coalesce(CASE WHEN high > low
  THEN least(floor((tag_value - low) / (high - low) * 40), 39) END, 0) AS bin FROM kept k JOIN spans USING (tag_name)),
histogram AS (SELECT tag_name, low + (high - low) * (bin + 0.5) / 40 AS bin_center, count(*) AS value_count
  FROM binned GROUP BY ALL)"""
_GAPS = """steps AS (SELECT *, epoch_us(Pi_Timestamp) // 1000000 - lag(epoch_us(Pi_Timestamp) // 1000000)
  OVER (PARTITION BY tag_name ORDER BY Pi_Timestamp) AS gap FROM kept)"""
_WORN = "tag_name IN ('click', 'error', 'view')"
_IN_WINDOW = f"Pi_Timestamp >= TIMESTAMP '{WINDOW[0]}' AND Pi_Timestamp < TIMESTAMP '{WINDOW[1]}'"
_KEY = "regexp_replace(trim(lower({name})), '[^a-z0-9]+', '_', 'g')"
_ASKED = "asked AS (SELECT tag_key, arg_min(requested_tag, position) AS requested_tag FROM (SELECT *, {key} AS tag_key FROM (VALUES {rows}) AS v(position, requested_tag)) GROUP BY tag_key)".format(
    key=_KEY.format(name="requested_tag"), rows=", ".join(f"({i}, '{name}')" for i, name in enumerate(REQUESTED))
)
_NEAR = """near AS (SELECT i.incident_id, i.incident_start, i.incident_end, l.* FROM incident i JOIN long l
  ON l.tag_name = i.tag_name AND l.Pi_Timestamp >= i.incident_start - INTERVAL 1 HOUR
  AND l.Pi_Timestamp <= i.incident_end + INTERVAL 1 HOUR)"""
_CONTEXT = """context AS (SELECT i.incident_id, count(n.tag_value) AS row_count, min(Pi_Timestamp) AS first_ts,
  max(Pi_Timestamp) AS last_ts, min(tag_value) AS overall_min, max(tag_value) AS overall_max,
  round(avg(tag_value), 8) AS overall_mean, min(inside) AS incident_min, max(inside) AS incident_max,
  round(avg(inside), 8) AS incident_mean, arg_max(tag_value, Pi_Timestamp) AS latest_value
  FROM incident i LEFT JOIN (SELECT *, CASE WHEN Pi_Timestamp BETWEEN incident_start AND incident_end
    THEN tag_value END AS inside FROM near) n USING (incident_id) GROUP BY i.incident_id)"""
_PHASE_COLUMNS = """window_phase, count(*) AS point_count, min(Pi_Timestamp) AS first_ts,
  max(Pi_Timestamp) AS last_ts, min(tag_value) AS min_value, round(avg(tag_value), 8) AS avg_value,
  max(tag_value) AS max_value, round(stddev_samp(tag_value), 8) AS stddev_value"""
_WINDOWS = f"{_MATCHED}, windows AS (SELECT incident_id, rule_type, run_id AS log_run_id, window_start, window_end, {_LIMITS} FROM matched WHERE recent_min IS NOT NULL)"
_TRIGGER = f"""newest AS (SELECT * FROM windows QUALIFY row_number() OVER (
    PARTITION BY incident_id ORDER BY window_start DESC, log_run_id DESC) = 1),
trigger AS (SELECT incident_id, CASE WHEN lower_threshold IS NULL THEN 'not_available'
    WHEN recent_min < lower_threshold OR recent_max > upper_threshold THEN 'breached' ELSE 'not_breached' END AS trigger_status,
  concat_ws(',', CASE WHEN recent_min < lower_threshold THEN 'lower' END,
    CASE WHEN recent_max > upper_threshold THEN 'upper' END) AS breached_thresholds,
  recent_min, recent_max, lower_threshold, upper_threshold,
  recent_min < lower_threshold AS below_lower_threshold, recent_max > upper_threshold AS above_upper_threshold
  FROM newest)"""


def _single_grid(lookback: int) -> str:
    end = RUN_AT.replace(second=0)
    return f"""grid AS (SELECT tag_name, 1 AS run_no, TIMESTAMP '{end}' AS window_end,
  TIMESTAMP '{end}' - INTERVAL {lookback} MINUTE AS window_start
  FROM (SELECT * FROM {_TAGS} UNION ALL SELECT 'absent'))"""


_SINGLE_RUN = f"'demo station__{RUN_AT:%Y%m%d_%H%M%S}' AS run_id"
_HOURLY_RUN = f"{_RUN_ID.format(ts='window_end')} AS run_id"
_STUCK_COLUMNS = "tag_name, window_start, window_end, status, valid_count, min_value, max_value, range_value"


def _freshness(name: str, source: str) -> str:
    latest = f"(SELECT coalesce(max(ts), TIMESTAMP '1900-01-01') AS latest FROM events WHERE {source})"
    return f"""SELECT 'demo station__20240120_123045' AS run_id, 'demo station' AS station, '{name}' AS source_table,
  '_table_' AS tag_name, 'freshness_lag' AS rule_type, TIMESTAMP '2024-01-20 12:00:00' AS window_start,
  TIMESTAMP '2024-01-20 12:30:00' AS window_end,
  CASE WHEN latest < TIMESTAMP '2024-01-30 23:40:00' THEN 'failed' ELSE 'pass' END AS status,
  round(floor((epoch_us(TIMESTAMP '2024-01-31 00:10:00') - epoch_us(latest)) / 1e6) / 60.0, 8) AS late_in_minutes,
  latest AS latest_batch_ts, TIMESTAMP '2024-01-31 00:10:00' AS current_ts,
  TIMESTAMP '2024-01-20 12:30:45' AS create_ts FROM {latest}"""


_PHASE_CASE = (
    f"CASE WHEN Pi_Timestamp < TIMESTAMP '{PHASES[1]}' THEN 'before' "
    f"WHEN Pi_Timestamp < TIMESTAMP '{PHASES[2]}' THEN 'during' ELSE 'after' END AS window_phase"
)
_SHIFT = ", ".join(
    f"round(max(CASE WHEN period = 'recent' THEN {p} END) - max(CASE WHEN period = 'baseline' THEN {p} END), 8) AS {p}_shift"
    for p in ("p1", "p50", "p99")
)

ORACLES: dict[str, str] = {
    "wide_to_long": f"WITH {_WIDE} SELECT * FROM wide UNPIVOT (tag_value FOR tag_name IN (click, error, purchase, signup, \"view\"))",
    "long_table_summary": f"WITH {_ITEM_READINGS} SELECT count(*) AS row_count, count(DISTINCT tag_name) AS tag_count, min(Pi_Timestamp) AS min_ts, max(Pi_Timestamp) AS max_ts FROM readings WHERE tag_value IS NOT NULL AND Pi_Timestamp IS NOT NULL",
    "tag_summary": f"WITH {_LONG} SELECT tag_name, count(*) AS row_count, min(Pi_Timestamp) AS min_ts, max(Pi_Timestamp) AS max_ts FROM long WHERE {_WORN} GROUP BY tag_name",
    "history_slice": "SELECT l_shipdate AS Pi_Timestamp, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01'",
    "tag_history": "SELECT l_shipdate AS Pi_Timestamp, l_quantity, l_tax FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-01' ORDER BY 1",
    "incident_history": f"WITH {_WIDE} SELECT Pi_Timestamp, click FROM wide WHERE Pi_Timestamp BETWEEN TIMESTAMP '2024-01-09 23:00:00' AND TIMESTAMP '2024-01-14 01:00:00'",
    "comparison_long": f"WITH {_EVENT_READINGS} SELECT Pi_Timestamp, tag_name AS tag, replace(tag_name, '_', ' ') AS display_name, tag_value AS value FROM readings WHERE tag_name <> 'click'",
    "comparison_xy": "SELECT l_shipdate AS Pi_Timestamp, l_quantity, l_extendedprice, l_discount FROM lineitem",
    "layout_long_table": f"WITH {_LONG} SELECT tag_name, count(*) AS rows, count(DISTINCT Pi_Timestamp) AS times FROM long GROUP BY tag_name",
    "map_fields": """SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN ts - INTERVAL 12 HOUR ELSE ts END AS Pi_Timestamp,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS Net_Power,
  CASE WHEN event_type = 'click' THEN value END AS Vacuum_Pump_40_Current,
  value AS LP_STEAM_PRESSURE_2, NULL::DOUBLE AS Humidity FROM events""",
    "load_json": """WITH f AS (SELECT *, event_id % 11 = 0 AS cut, event_id % 11 <> 0 AND event_id % 7 > 1 AS good FROM events)
SELECT event_id, CASE WHEN good THEN ts END AS Pi_Timestamp, CASE WHEN good AND event_id % 5 <> 0 THEN value END AS Net_Power,
  CASE WHEN good AND event_id % 3 = 1 THEN value END AS LP_STEAM_PRESSURE_2, good AS loaded,
  CASE WHEN cut THEN '-:not JSON' ELSE concat_ws(',',
    CASE event_id % 7 WHEN 0 THEN 'Pi_Timestamp:not a time:not a time' WHEN 1 THEN 'Pi_Timestamp:no time' END,
    CASE WHEN event_id % 5 = 0 THEN 'Net_Power:not a number:No Data' END,
    CASE WHEN event_id % 3 = 0 THEN 'LP_STEAM_PRESSURE_2:not a number:Bad' END) END AS problems FROM f""",
    "late_readings": """WITH b AS (SELECT *, CASE WHEN event_id % 50 = 7 OR ts >= TIMESTAMP '2024-01-21' THEN 2 WHEN ts < TIMESTAMP '2024-01-11' THEN 0 ELSE 1 END AS batch FROM events),
m AS (SELECT n.batch, (SELECT max(ts) FROM b WHERE b.batch < n.batch) - INTERVAL 5 DAY AS watermark FROM (SELECT DISTINCT batch FROM b) n),
l AS (SELECT b.*, watermark, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= watermark, false) AS behind FROM b JOIN m USING (batch)),
c AS (SELECT batch, count(*) AS arrived, count(*) FILTER (behind) AS late FROM l GROUP BY batch)
SELECT batch, ts AS Pi_Timestamp, event_type AS tag_name, value AS tag_value, watermark, arrived, late FROM l JOIN c USING (batch) WHERE behind""",
    "add_noise": "SELECT event_type AS tag_name, count(*) AS row_count, count(*) AS rows_in_bounds, true AS mostly_moved FROM events GROUP BY 1",
    "add_noise_keyed": "SELECT event_type AS tag_name, count(*) AS row_count, count(*) AS rows_in_bounds, true AS mostly_moved, count(*) AS rows_alike FROM events GROUP BY 1",
    "stuck_value_hourly": f"WITH {_LONG}, {_grid(60)}, {_stuck('stuck', 60, 3, 40.0, _ZERO)} SELECT {_HOURLY_RUN}, {_STUCK_COLUMNS} FROM stuck",
    "stuck_value_overlapping": f"WITH {_LONG}, {_grid(180)}, {_stuck('stuck', 180, 5, 60.0, chr(39) * 2)} SELECT {_HOURLY_RUN}, {_STUCK_COLUMNS} FROM stuck",
    "stuck_value_single": f"WITH {_LONG}, {_single_grid(180)}, {_stuck('stuck', 180, 5, 60.0, chr(39) * 2)} SELECT {_SINGLE_RUN}, {_STUCK_COLUMNS}, TIMESTAMP '{RUN_AT}' AS create_ts FROM stuck",
    "recent_extrema": f"WITH {_LONG}, {_grid(60)} SELECT g.tag_name, run_no, min(tag_value) AS recent_min, max(tag_value) AS recent_max FROM grid g JOIN long l ON l.tag_name = g.tag_name AND Pi_Timestamp >= window_start AND Pi_Timestamp < window_end GROUP BY ALL",
    "iqr_fences": f"WITH {_LONG}, q AS (SELECT tag_name, quantile_disc(tag_value, 0.25) AS history_q1, quantile_disc(tag_value, 0.75) AS history_q3 FROM long GROUP BY tag_name) SELECT *, round(history_q1 - (history_q3 - history_q1) * 1.5, 8) AS lower_fence, round(history_q3 + (history_q3 - history_q1) * 1.5, 8) AS upper_fence FROM q",
    "fenced_p1_p99": f"WITH {_LONG}, q AS (SELECT tag_name, quantile_disc(tag_value, 0.25) AS q1, quantile_disc(tag_value, 0.75) AS q3 FROM long GROUP BY tag_name) SELECT tag_name, quantile_disc(tag_value, 0.01) AS history_p1, quantile_disc(tag_value, 0.99) AS history_p99 FROM long JOIN q USING (tag_name) WHERE tag_value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 GROUP BY tag_name",
    "trailing_sketch": f"WITH {_LONG}, {_grid(60)}, {_history(14)} SELECT tag_name, run_no, history_count, true AS q1_within, true AS q3_within, true AS p1_within, true AS p99_within FROM fences",
    "trailing_percentiles": f"WITH {_LONG}, {_grid(60)}, {_history(14)} SELECT f.tag_name, f.run_no, history_count, history_q1, history_q3, round(lower_fence, 8) AS lower_fence, round(upper_fence, 8) AS upper_fence, history_p1, history_p99 FROM fences f LEFT JOIN tails t ON t.tag_name = f.tag_name AND t.run_no = f.run_no",
    "outlier_hourly": f"WITH {_LONG}, {_grid(60)}, {_history(7)}, {_judged('wild')} SELECT {_HOURLY_RUN}, tag_name, window_start, window_end, status, recent_min, recent_max, history_p1, history_p99, round(lower_threshold, 8) AS lower_threshold, round(upper_threshold, 8) AS upper_threshold FROM wild",
    "outlier_single": f"WITH {_LONG}, {_single_grid(30)}, {_history(14)}, {_judged('wild')} SELECT {_SINGLE_RUN}, tag_name, window_start, window_end, status, recent_min, recent_max, history_p1, history_p99, round(lower_threshold, 8) AS lower_threshold, round(upper_threshold, 8) AS upper_threshold, TIMESTAMP '{RUN_AT}' AS create_ts FROM wild",
    "freshness": " UNION ALL ".join([_freshness("events", "true"), _freshness("errors", "event_type = 'error'"), _freshness("empty", "event_type = 'absent'")]),
    "monitoring_backfill": f"WITH {_INCIDENTS} SELECT * FROM incident",
    "observed_values": f"WITH {_LOG} SELECT run_id, tag_name, rule_type, valid_count::DOUBLE AS valid_count, min_value, max_value, round(range_value, 8) AS range, recent_min, recent_max, history_p1, history_p99, round(lower_threshold, 8) AS lower_threshold, round(upper_threshold, 8) AS upper_threshold FROM log",
    "monitor_log": f"WITH {_LOG} SELECT {_LOG_COLUMNS} FROM log",
    "incident_groups": f"WITH {_LOG}, {_incidents(3 * 3600)} SELECT * FROM ranges",
    "incident_merge": f"WITH {_INCIDENTS} SELECT * FROM incident",
    "incident_merge_increment": f"WITH {_INCIDENTS} SELECT * FROM incident",
    "late_rows": f"WITH {_LOG} SELECT {_LOG_COLUMNS} FROM log l WHERE status = 'failed' AND create_ts < TIMESTAMP '{SPLIT_AT}' AND NOT EXISTS (SELECT 1 FROM log s WHERE s.status = 'failed' AND s.create_ts >= TIMESTAMP '{SPLIT_AT}' AND s.tag_name = l.tag_name AND s.rule_type = l.rule_type AND l.window_start <= s.window_end AND l.window_end >= s.window_start)",
    "recent_incidents": f"WITH {_RECENT} SELECT * REPLACE ('Station A' AS station, feedback_count::DOUBLE AS feedback_count) FROM recent_rows",
    "incident_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
    "incident_metrics": f"WITH {_SUMMARY} SELECT count(*) AS incidents, count(DISTINCT CASE WHEN tag_name <> '_table_' THEN tag_name END) AS problem_tags, count(DISTINCT rule_type) AS rule_types FROM summary",
    "feedback_counts": f"WITH {_FEEDBACK} SELECT * FROM notes",
    "session_approximation": f"WITH {_INCIDENTS}, {_MATCHED} SELECT i.station, i.source_table, i.tag_name, i.rule_type, i.status, i.incident_start, i.incident_end, count(*) AS failed_windows FROM incident i JOIN matched m USING (incident_id) GROUP BY ALL",
    "profile_stats": f"WITH {_ITEM_READINGS}, {_stats(LINEITEM_PERIODS, _ITEM_TAGS, 7)} SELECT * FROM stats",
    "profile_stats_with_nulls": f"WITH {_EVENT_STATS} SELECT * FROM stats",
    "daily_trend": f"WITH {_TREND} SELECT * FROM trend",
    "gap_stats": f"WITH {_HISTOGRAM}, {_GAPS} SELECT tag_name, count(gap) AS interval_count, count(*) FILTER (gap > 900) AS large_gap_count, round(avg(gap) / 60, 8) AS average_gap_minutes, round(max(gap) / 60, 8) AS longest_gap_minutes FROM steps GROUP BY tag_name",
    "percentile_shift": f"WITH {_EVENT_STATS} SELECT tag_name, {_SHIFT} FROM stats GROUP BY tag_name",
    "drift_long": f"WITH {_EVENT_STATS} SELECT tag_name, period, percentile, value FROM (SELECT tag_name, period, p1, p50, p99 FROM stats) UNPIVOT (value FOR percentile IN (p1, p50, p99))",
    "trend_summary": f"WITH {_TREND} SELECT tag_name, count(*) AS day_count, min(p1) AS min_p1, max(p1) AS max_p1, min(p50) AS min_p50, max(p50) AS max_p50, min(p99) AS min_p99, max(p99) AS max_p99, min(null_rate) AS min_null_rate, max(null_rate) AS max_null_rate, max(profile_date) AS latest_date, arg_max(p50, profile_date) AS latest_p50 FROM trend GROUP BY tag_name",
    "availability_long": f"WITH {_TREND} SELECT * FROM (SELECT tag_name, profile_date, non_null_count, null_count FROM trend) UNPIVOT (point_count FOR point_type IN (non_null_count, null_count))",
    "trend_long": f"WITH {_TREND} SELECT * FROM (SELECT tag_name, profile_date, p1, p50, p99 FROM trend) UNPIVOT (value FOR percentile IN (p1, p50, p99))",
    "histogram_fixed": f"WITH {_HISTOGRAM} SELECT tag_name, round(bin_center, 8) AS bin_center, value_count FROM histogram",
    "density": f"WITH {_HISTOGRAM} SELECT tag_name, round(bin_center, 8) AS bin_center, value_count, round(value_count / sum(value_count) OVER (PARTITION BY tag_name), 8) AS density FROM histogram",
    "density_summary": f"WITH {_HISTOGRAM}, placed AS (SELECT *, row_number() OVER (PARTITION BY tag_name ORDER BY value_count DESC, bin_center) AS place FROM histogram) SELECT tag_name, count(*) AS bin_count, sum(value_count)::BIGINT AS total_count, round(max(CASE WHEN place = 1 THEN bin_center END), 8) AS fullest_bin, max(CASE WHEN place = 5 THEN value_count END) AS fifth_count FROM placed GROUP BY tag_name",
    "histogram_adaptive_totals": "SELECT event_type AS tag_name, 40::BIGINT AS bin_count, count(*) AS total_count FROM events GROUP BY 1",
    "tag_profile": f"WITH {_TREND} SELECT 'stats' AS part, 10::BIGINT AS row_count UNION ALL SELECT 'histogram', 200 UNION ALL SELECT 'daily_trend', count(*) FROM trend UNION ALL SELECT 'gap', count(DISTINCT event_type) FROM events",
    "tag_profile_report": f"""WITH {_EVENT_STATS}, {_TREND.removeprefix(_EVENT_READINGS + ',')},
{_HISTOGRAM.removeprefix(_EVENT_READINGS + ',')}, {_GAPS}
SELECT b.tag_name, b.row_count AS baseline_rows, r.non_null_count AS recent_values, round(r.p50, 6) AS recent_p50,
  round(r.p99 - b.p99, 6) AS p99_shift,
  (SELECT count(*) FROM histogram h WHERE h.tag_name = b.tag_name) AS bin_count,
  (SELECT count(*) FROM trend t WHERE t.tag_name = b.tag_name) AS day_count,
  (SELECT round(max(p99), 6) FROM trend t WHERE t.tag_name = b.tag_name) AS max_p99,
  (SELECT count(*) FROM steps s WHERE s.tag_name = b.tag_name AND gap > 900) AS large_gap_count,
  '2024-01-21 13:00 NZT' AS recent_start_nzt
FROM stats b JOIN stats r ON r.tag_name = b.tag_name AND r.period = 'recent' WHERE b.period = 'baseline'""",
    "tag_catalog": f"WITH {_LONG} SELECT count(DISTINCT tag_name) AS tag_count, string_agg(DISTINCT tag_name, ',' ORDER BY tag_name) AS tags, min(Pi_Timestamp) AS min_ts, max(Pi_Timestamp) AS max_ts FROM long",
    "raw_points_sample": f"WITH {_LONG} SELECT * FROM (SELECT tag_name, Pi_Timestamp, tag_value, row_number() OVER (PARTITION BY tag_name ORDER BY Pi_Timestamp, tag_value) AS point_rank, count(*) OVER (PARTITION BY tag_name) AS total_points FROM long WHERE {_WORN} AND {_IN_WINDOW}) WHERE point_rank <= 200",
    "window_stats": f"WITH {_LONG} SELECT tag_name, count(*) AS point_count, min(Pi_Timestamp) AS first_ts, max(Pi_Timestamp) AS last_ts, min(tag_value) AS min_value, quantile_disc(tag_value, 0.25) AS p25_value, round(avg(tag_value), 8) AS avg_value, quantile_disc(tag_value, 0.5) AS median_value, quantile_disc(tag_value, 0.75) AS p75_value, max(tag_value) AS max_value, round(stddev_samp(tag_value), 8) AS stddev_value FROM long WHERE {_WORN} AND {_IN_WINDOW} GROUP BY tag_name",
    "phase_stats": f"WITH {_LONG} SELECT tag_name, {_PHASE_COLUMNS} FROM (SELECT *, {_PHASE_CASE} FROM long WHERE {_WORN} AND Pi_Timestamp >= TIMESTAMP '{PHASES[0]}' AND Pi_Timestamp < TIMESTAMP '{PHASES[3]}') GROUP BY tag_name, window_phase",
    "gap_profile": f"WITH {_LONG}, kept AS (SELECT * FROM long WHERE {_WORN} AND {_IN_WINDOW}), {_GAPS} SELECT tag_name, count(tag_value) AS point_count, min(Pi_Timestamp) AS first_ts, max(Pi_Timestamp) AS last_ts, max(gap) AS max_gap_seconds, round(avg(gap), 8) AS avg_gap_seconds, count(*) FILTER (gap > 300) AS gaps_over_5m, count(*) FILTER (gap > 900) AS gaps_over_15m FROM steps GROUP BY tag_name",
    "match_tag_names": f"WITH {_LONG}, {_ASKED}, known AS (SELECT {_KEY.format(name='tag_name')} AS tag_key, min(tag_name) AS matched_tag, count(*) AS catalog_point_count, min(Pi_Timestamp) AS catalog_min_ts, max(Pi_Timestamp) AS catalog_max_ts FROM long GROUP BY 1) SELECT requested_tag, matched_tag, catalog_point_count, catalog_min_ts, catalog_max_ts FROM known JOIN asked USING (tag_key)",
    "threshold_context": f"WITH {_LONG}, {_ASKED}, kept AS (SELECT l.*, requested_tag FROM long l JOIN asked ON {_KEY.format(name='tag_name')} = tag_key WHERE {_IN_WINDOW}) SELECT requested_tag, tag_name AS matched_tag, count(*) AS point_count, min(Pi_Timestamp) AS first_ts, max(Pi_Timestamp) AS last_ts, strftime(min(Pi_Timestamp) + INTERVAL 13 HOUR, '%Y-%m-%d %H:%M:%S') AS first_ts_nzt, strftime(max(Pi_Timestamp) + INTERVAL 13 HOUR, '%Y-%m-%d %H:%M:%S') AS last_ts_nzt, min(tag_value) AS min_value, round(avg(tag_value), 8) AS avg_value, max(tag_value) AS max_value, 10.0::DOUBLE AS lower_threshold, 120.0::DOUBLE AS upper_threshold, count(*) FILTER (tag_value < 10) AS below_lower_threshold_count, count(*) FILTER (tag_value > 120) AS above_upper_threshold_count FROM kept GROUP BY requested_tag, tag_name",
    "incident_packet": f"WITH {_FEEDBACK}, {_MATCHED}, logs AS (SELECT incident_id, count(*) AS log_rows, min(window_start) AS first_window, max(window_end) AS last_window FROM matched GROUP BY 1) SELECT i.*, coalesce(log_rows, 0) AS log_rows, first_window, last_window, coalesce(feedback_count, 0) AS feedback_rows FROM incident i LEFT JOIN logs USING (incident_id) LEFT JOIN notes USING (incident_id)",
    "incident_phase_stats": f"WITH {_INCIDENTS}, {_NEAR}, phased AS (SELECT *, CASE WHEN Pi_Timestamp < incident_start THEN 'before' WHEN Pi_Timestamp < incident_end THEN 'during' WHEN Pi_Timestamp < incident_end + INTERVAL 1 HOUR THEN 'after' END AS window_phase FROM near) SELECT incident_id, tag_name, {_PHASE_COLUMNS} FROM phased WHERE window_phase IS NOT NULL GROUP BY incident_id, tag_name, window_phase",
    "evidence_functions": f"""WITH {_INCIDENTS}, {_MATCHED},
kept AS (SELECT * FROM long WHERE tag_name IN ('click', 'view')), {_GAPS}
SELECT 'get_app_tag_catalog' AS name, 'executed' AS status, (SELECT count(DISTINCT tag_name) FROM long)::VARCHAR AS figure
UNION ALL SELECT 'get_incident_packet', 'executed',
  (SELECT min(run_id) FROM matched WHERE incident_id = (SELECT min(incident_id) FROM incident))
UNION ALL SELECT 'get_raw_points_sample', 'executed', (SELECT sum(least(n, 200)) FROM (SELECT count(*) AS n FROM kept GROUP BY tag_name))::VARCHAR
UNION ALL SELECT 'get_related_tag_window_stats', 'executed', (SELECT quantile_disc(tag_value, 0.75) FROM kept WHERE tag_name = 'click')::VARCHAR
UNION ALL SELECT 'get_before_during_after_stats', 'executed', (SELECT count(*) FROM kept WHERE tag_name = 'click'
  AND Pi_Timestamp >= TIMESTAMP '{PHASES[2]}' AND Pi_Timestamp < TIMESTAMP '{PHASES[3]}')::VARCHAR
UNION ALL SELECT 'get_missingness_gap_profile', 'executed', (SELECT max(gap) FROM steps WHERE tag_name = 'view')::VARCHAR
UNION ALL SELECT 'get_outlier_threshold_context', 'executed', (SELECT count(*) FROM kept WHERE tag_name = 'click' AND tag_value > 120)::VARCHAR""",
    "local_time": """SELECT date_trunc('day', local)::TIMESTAMP AS local_day, count(*) AS row_count,
  strftime(min(local), '%Y-%m-%d %H:%M:%S') AS first_local
FROM (SELECT timezone('Pacific/Auckland', timezone('UTC', l_shipdate)) AS local FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01') GROUP BY 1""",
    "threshold_windows": f"WITH {_INCIDENTS}, {_WINDOWS} SELECT incident_id, rule_type, log_run_id, window_start, window_end, recent_min, recent_max, history_p1, history_p99, round(lower_threshold, 8) AS lower_threshold, round(upper_threshold, 8) AS upper_threshold FROM windows",
    "trigger_summary": f"WITH {_INCIDENTS}, {_WINDOWS}, {_TRIGGER} SELECT * REPLACE (round(lower_threshold, 8) AS lower_threshold, round(upper_threshold, 8) AS upper_threshold) FROM trigger",
    "raw_context": f"WITH {_INCIDENTS}, {_NEAR}, {_CONTEXT} SELECT * FROM context",
    "first_logs": f"WITH {_INCIDENTS}, {_MATCHED} SELECT * FROM (SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY window_start, run_id) AS log_rank, run_id AS log_run_id, window_start, window_end, create_ts AS log_create_ts FROM matched) WHERE log_rank <= 2",
    "incident_report": f"""WITH {_INCIDENTS}, {_WINDOWS}, {_TRIGGER}, {_NEAR}, {_CONTEXT},
counts AS (SELECT incident_id, count(*) AS n FROM windows GROUP BY 1),
logs AS (SELECT incident_id, count(*) AS n FROM matched GROUP BY 1)
SELECT i.incident_id, strftime(incident_start + INTERVAL 13 HOUR, '%Y-%m-%d %H:%M') || ' NZT' AS incident_start_nzt,
  coalesce(trigger_status, 'not_available') AS trigger_status,
  CASE WHEN rule_type = 'outlier' AND lower_threshold IS NOT NULL THEN 'ready' ELSE 'not_ready' END AS request_status,
  coalesce(counts.n, 0) AS threshold_window_count, least(logs.n, 12) AS log_rows,
  row_count AS context_rows, round(latest_value, 6) AS latest_value
FROM incident i LEFT JOIN trigger USING (incident_id) LEFT JOIN counts USING (incident_id)
LEFT JOIN logs USING (incident_id) LEFT JOIN context USING (incident_id)""",
    "stream_stuck_value": f"""WITH {_LONG}, w AS (SELECT tag_name, time_bucket(INTERVAL 1 HOUR, Pi_Timestamp) AS window_start,
  CASE WHEN tag_name IN ({_ZERO}) AND tag_value = 0 THEN NULL ELSE tag_value END AS kept FROM long),
agg AS (SELECT tag_name, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(kept) AS valid_count,
  min(kept) AS min_value, max(kept) AS max_value FROM w GROUP BY ALL)
SELECT *, CASE WHEN valid_count < 3 THEN 'skipped' WHEN max_value - min_value <= 40 THEN 'failed' ELSE 'pass' END AS status
FROM agg""",
    "incident_merge_late": f"WITH {_INCIDENTS} SELECT * FROM ranges",
    "derived_tags": f"""WITH {_FLOWS}, hp AS (SELECT *, steam - supply AS hp_flow,
  CASE WHEN hp_in >= lp_in THEN 44.18 * sqrt(hp_in * hp_in - lp_in * lp_in) END AS hp_made,
  CASE WHEN lp_in >= condenser THEN 355.45 * sqrt(lp_in * lp_in - condenser * condenser) END AS total_made FROM flows)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(hp_flow, 6) + 0 AS HP_TURBINE_STEAM_FLOW,
  round(hp_made, 6) + 0 AS HP_turbine_steam_flow_calculated, round(steam - hp_made, 6) + 0 AS GES_calculated,
  round(total_made, 6) + 0 AS Total_turbine_steam_flow_calculated, round(total_made - hp_made, 6) + 0 AS LP_turbine_steam_flow_calculated FROM hp""",
    "cross_check": f"""WITH {_FLOWS}, sums AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  steam + brine AS a, CASE WHEN brine >= 10 THEN brine ELSE 0 END + CASE WHEN lp_steam >= 10 THEN lp_steam ELSE 0 END AS b,
  steam + reinjected + lp_steam AS c, turbine + supply + reinjected AS d FROM flows)
SELECT l_orderkey, l_linenumber, round(a, 6) AS HP_VENTURI_STEAM_plus_HP_BRINE, round(b, 6) AS Sum_of_wells,
  round(c, 6) AS HP_VENTURI_STEAM_plus_LP_BRINE_plus_LP_STEAM, round(d, 6) AS TOTAL_TURBINE_FLOW_plus_GES_plus_LP_BRINE,
  round(greatest(a, b, c, d) - least(a, b, c, d), 6) AS spread,
  round((greatest(a, b, c, d) - least(a, b, c, d)) / nullif((a + b + c + d) / 4, 0), 6) AS relative_spread FROM sums""",
    "stream_incidents": f"WITH {_INCIDENTS} SELECT * FROM ranges",
}

# A finished stream and the batch agree.
ORACLES["stream_stuck_hourly"] = ORACLES["stuck_value_hourly"]
ORACLES["stream_outlier"] = ORACLES["outlier_hourly"]
ORACLES["stream_closing_incidents"] = ORACLES["incident_merge"]
