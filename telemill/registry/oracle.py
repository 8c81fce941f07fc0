"""The same answers in plain SQL, stated directly over the shared tables."""

from __future__ import annotations

import re

from telemill import contract as C
from telemill.functions import verdicts as V
from telemill.sources import bridge

W = "hour"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _text(pairs) -> str:
    """``k=v`` text of a map in key order; a pair with a condition may be absent."""
    items = []
    for key, value, cond in sorted(pairs):
        item = f"'{key}=' || {value}"
        items.append(f"CASE WHEN {cond} THEN {item} END" if cond else item)
    return "concat_ws(',', " + ", ".join(items) + ")"


_RESOURCE = [
    (C.KEY_SYNTHETIC, "CASE WHEN event_id % 50 = 0 THEN 'false' ELSE 'true' END", ""),
    (C.KEY_SCENARIO, "scenario", ""), (C.KEY_RUN_ID, "run", "event_id % 10 <> 0"),
    (C.KEY_PROVIDER, "'gcp'", "event_id % 40 <> 0"),
    (C.KEY_SERVICE, "producer", "event_id % 101 <> 0"),
]
RAW_RESOURCE = _text(_RESOURCE)
RESOURCE = _text([*_RESOURCE, (C.KEY_CONTRACT_VERSION, f"'{C.CONTRACT_VERSION}'", "")])
COMPONENT = _text([(C.KEY_COMPONENT_NAME, "event_type", ""),
                   (C.KEY_COMPONENT_TYPE, "component_type", "")])

EVENTS = f"""
e AS (SELECT *,
    CASE WHEN event_id % 40 < 4 THEN event_id % 40 ELSE event_id END AS k,
    epoch_us(ts) * 1000 + event_id % 1000 AS ns,
    {_list(bridge.SERVICES)}[CAST(user_id % {len(bridge.SERVICES)} AS INTEGER) + 1] AS producer,
    {_list(bridge.SCENARIOS)}[CAST(day(ts) % 3 AS INTEGER) + 1] AS scenario,
    strftime(ts, '%Y-%m-%d') AS run,
    {_list(bridge.COMPONENT_TYPES)}[CAST(user_id % 3 AS INTEGER) + 1] AS component_type
  FROM events),
b AS (SELECT *,
    CASE WHEN event_id % 101 = 0 THEN '' ELSE producer END AS service_name,
    CASE WHEN event_id % 10 = 0 THEN '' ELSE run END AS run_id,
    CASE WHEN event_id % 40 = 0 THEN '' ELSE 'gcp' END AS cloud_provider,
    event_id % 50 <> 0 AS is_synthetic, '{C.CONTRACT_VERSION}' AS contract_version,
    md5(CAST(k // 4 AS VARCHAR)) AS trace_id, substr(md5('s' || k), 1, 16) AS span_id,
    CASE WHEN k % 4 <> 0 THEN substr(md5('s' || (k - 1)), 1, 16) ELSE '' END AS parent_span_id,
    CAST(floor(value * 1000000) AS BIGINT) AS duration_ns,
    {RESOURCE} AS resource, {RAW_RESOURCE} AS raw_resource, {COMPONENT} AS component
  FROM e)"""

SILVER = f"""{EVENTS},
ops AS (SELECT event_id, ts AS event_time, ns AS event_time_ns,
    make_timestamp((ns + duration_ns) // 1000) AS end_time, ns + duration_ns AS end_time_ns,
    scenario, run_id, cloud_provider, is_synthetic, contract_version, service_name,
    event_type AS component_name, component_type, event_type AS operation_name, trace_id, span_id,
    parent_span_id, duration_ns, duration_ns / 1000000.0 AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Ok' END AS status_code,
    event_type = 'error' AS is_error, resource, component FROM b),
logs0 AS (SELECT event_id, ts AS event_time, ns AS event_time_ns, scenario, run_id,
    cloud_provider, is_synthetic, contract_version, service_name, event_type AS component_name,
    CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN'
      WHEN event_type = 'click' AND event_id % 17 = 0 THEN 'fatal' ELSE 'INFO' END
      AS severity_text,
    CAST(CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'signup' THEN 13 ELSE 9 END
      AS BIGINT) AS severity_number,
    event_type || ' ' || props AS body, CASE WHEN event_id % 6 = 0 THEN '' ELSE trace_id END
      AS trace_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE span_id END AS span_id, resource,
    component, component_type FROM b),
logs AS (SELECT *, severity_number >= {C.ERROR_SEVERITY_NUMBER}
    OR upper(severity_text) IN {C.ERROR_SEVERITY_TEXTS} AS is_error FROM logs0),
mets AS (SELECT event_id, ts AS event_time, ns AS event_time_ns, scenario, run_id,
    cloud_provider, is_synthetic, contract_version, service_name, event_type AS component_name,
    component_type, m.name AS metric_name, m.kind AS metric_kind, m.unit AS metric_unit,
    m.v AS value, '' AS status, resource, component
  FROM (SELECT b.*, unnest([
      {{'name': 'operation.latency_ms', 'kind': 'gauge', 'unit': 'ms', 'v': value}},
      {{'name': 'operation.request_count', 'kind': 'sum', 'unit': '1', 'v': 1.0::DOUBLE}},
      {{'name': 'operation.error_count', 'kind': 'sum', 'unit': '1', 'v': 1.0::DOUBLE}}]) AS m
    FROM b) WHERE m.name <> 'operation.error_count' OR event_type = 'error'),
everything AS (
  SELECT 'log' AS signal, event_id, event_time, event_time_ns, scenario, run_id, service_name,
    component_name, '' AS metric_name, trace_id, is_error, is_synthetic FROM logs
  UNION ALL SELECT 'trace', event_id, event_time, event_time_ns, scenario, run_id, service_name,
    component_name, '', trace_id, is_error, is_synthetic FROM ops
  UNION ALL SELECT 'metric', event_id, event_time, event_time_ns, scenario, run_id, service_name,
    component_name, metric_name, '', false, is_synthetic FROM mets)"""


def _with(prelude: str, select: str) -> str:
    """``select`` may begin with a comma to add further named tables."""
    return f"WITH {prelude.strip()}\n{select.strip()}"


def silver(select: str) -> str:
    return _with(SILVER, select)


def _b(select: str) -> str:
    return _with(EVENTS, select)


ORACLE: dict[str, str] = {}
O = ORACLE

# -- NDJSON -------------------------------------------------------------------

PARSED = f"""{EVENTS},
raw AS (SELECT *, ['log', 'span', 'metric'][CAST(event_id % 3 AS INTEGER) + 1] AS kind,
    CASE WHEN event_id % 61 = 0 THEN -1 ELSE ns END AS start
  FROM b WHERE event_id % 89 <> 0),
parsed AS (SELECT *, CASE
    WHEN event_id % 97 = 0 THEN 'malformed'
    WHEN event_id % 53 = 0 THEN 'signal_type'
    WHEN kind = 'log' AND event_id % 37 = 0 THEN 'field:severity_text'
    WHEN event_id % 83 = 0 THEN 'field:attributes'
    WHEN kind = 'span' AND event_id % 47 = 0 THEN 'status_code'
    WHEN kind = 'metric' AND event_id % 43 = 0 THEN 'type' ELSE '' END AS parse_error FROM raw),
checked AS (SELECT *, CASE
    WHEN parse_error <> '' THEN ''
    WHEN event_id % 79 = 0 THEN 'invalid_semver'
    WHEN event_id % 73 = 0 THEN 'version_mismatch'
    WHEN event_id % 67 = 0 THEN 'empty_service_name'
    WHEN event_id % 61 = 0 THEN 'negative_timestamp'
    WHEN kind = 'span' AND event_id % 59 = 0 THEN 'invalid_span_interval'
    WHEN kind = 'span' AND event_id % 71 = 0 THEN 'invalid_trace_id'
    WHEN kind = 'metric' AND event_id % 41 = 0 THEN 'empty_metric_name'
    WHEN event_id % 10 = 0 THEN 'missing_resource_key:{C.KEY_RUN_ID}'
    WHEN event_id % 40 = 0 THEN 'missing_resource_key:{C.KEY_PROVIDER}'
    WHEN event_id % 101 = 0 THEN 'missing_resource_key:{C.KEY_SERVICE}'
    ELSE '' END AS error_code FROM parsed)"""


def parsed(select: str) -> str:
    return _with(PARSED, select)


O["read_signals_ndjson"] = parsed("""
SELECT event_id, parse_error, CASE WHEN parse_error = '' THEN kind END AS signal_type,
  CASE WHEN parse_error = '' THEN CAST(start AS VARCHAR) END AS ns,
  CASE WHEN parse_error = '' AND kind = 'metric' THEN value END AS value,
  CASE WHEN parse_error = '' THEN component END AS attributes,
  CASE WHEN parse_error = '' THEN raw_resource END AS resource_attributes FROM parsed""")
for _kind in ("log", "span", "metric"):
    O[f"validate_{_kind}"] = parsed(
        f"SELECT event_id, error_code FROM checked WHERE parse_error = '' AND kind = '{_kind}'")
O["validate_type_domain"] = parsed(
    "SELECT parse_error, count(*) AS n FROM parsed WHERE parse_error <> '' GROUP BY 1")
O["signal_counts"] = parsed("""
SELECT count(*) FILTER (good AND kind = 'log') AS logs,
  count(*) FILTER (good AND kind = 'span') AS spans,
  count(*) FILTER (good AND kind = 'metric') AS metrics,
  count(*) FILTER (parse_error <> '') AS parse_errors,
  count(*) FILTER (error_code <> '') AS validation_errors
FROM (SELECT *, parse_error = '' AND error_code = '' AS good FROM checked)""")
O["strict_batch_gate"] = parsed("""
SELECT *, parse_errors > 0 OR validation_errors > 0 AS refused FROM (
  SELECT event_id // 7 AS batch, count(*) FILTER (good AND kind = 'log') AS logs,
    count(*) FILTER (good AND kind = 'span') AS spans, count(*) FILTER (good AND kind = 'metric') AS metrics,
    count(*) FILTER (parse_error <> '') AS parse_errors, count(*) FILTER (error_code <> '') AS validation_errors
  FROM (SELECT *, parse_error = '' AND error_code = '' AS good FROM checked) GROUP BY 1)""")
O["apply_policy"] = parsed("""
SELECT p.policy, CASE WHEN p.policy = 'strict' THEN n - bad ELSE n END AS kept,
  CASE WHEN p.policy = 'off' THEN 0 ELSE bad END AS rejected
FROM (SELECT count(*) AS n, count(*) FILTER (error_code <> '') AS bad FROM checked
      WHERE parse_error = '') CROSS JOIN (VALUES ('off'), ('warn'), ('strict')) p(policy)""")
O["strict_kept"] = parsed("""SELECT event_id, kind AS signal_type FROM checked
WHERE parse_error = '' AND error_code = ''""")
O["reject_matrix"] = parsed("""
SELECT split_part(error_code, ':', 1) AS reason, kind AS signal, count(*) AS rejected
FROM checked WHERE error_code <> '' GROUP BY 1, 2""")
O["route_metric"] = parsed("""
SELECT t.tbl, count(parsed.event_id) FILTER (parse_error = '' AND kind = 'metric') AS n
FROM (VALUES ('gauge'), ('sum')) t(tbl) LEFT JOIN parsed ON t.tbl = 'gauge' GROUP BY 1""")
O["write_bronze"] = parsed("""
SELECT CASE kind WHEN 'log' THEN 'otel_logs' WHEN 'span' THEN 'otel_traces'
    ELSE 'otel_metrics_gauge' END AS tbl,
  CASE WHEN start < 0 THEN '1969-12-31' ELSE run END AS day, service_name AS "ServiceName",
  count(*) AS n FROM parsed WHERE parse_error = '' GROUP BY 1, 2, 3""")
O["stream_ingest"] = parsed("""
SELECT CASE WHEN start < 0 THEN '1969-12-31' ELSE run END AS day, service_name,
  CASE kind WHEN 'span' THEN 'trace' ELSE kind END AS signal, count(*) AS rows
FROM parsed WHERE parse_error = '' GROUP BY 1, 2, 3""")

# -- OTLP ---------------------------------------------------------------------

_NUMBER = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) " \
          "ELSE CAST(value AS VARCHAR) END"
_OTLP_PAIRS = [("text", "event_type", ""), ("flag", "CAST(event_type = 'error' AS VARCHAR)", ""),
               ("count", "user_id", ""), ("ratio", f"({_NUMBER})", ""),
               ("whole", "CAST(floor(value) AS BIGINT)", ""), ("nothing", "''", "")]
_OTLP_ATTRS = _text(_OTLP_PAIRS)
_SENDER = f"CASE WHEN event_id % 101 = 0 THEN '{C.UNKNOWN_SERVICE}' ELSE producer END"
_STATUS = "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END"
O["flatten_otlp_traces"] = _b(f"""
SELECT trace_id, substr(md5('s' || (k + o)), 1, 16) AS span_id, parent_span_id,
  event_type AS name, {_SENDER} AS service_name, ns + o AS start_unix_nano,
  ns + o + duration_ns AS end_unix_nano, {_STATUS} AS status_code, contract_version,
  {_OTLP_ATTRS} AS attributes, raw_resource AS resource_attributes
FROM b CROSS JOIN (VALUES (0), (500000)) v(o)""")
O["attrs_to_map"] = _b("""
SELECT p.key, p.text, count(*) * 2 AS n FROM (SELECT unnest(["""
    + ", ".join(f"{{'key': '{k}', 'text': CAST({v} AS VARCHAR)}}" for k, v, _ in _OTLP_PAIRS)
    + "]) AS p FROM b) GROUP BY 1, 2")
O["flatten_otlp_logs"] = _b(f"""
SELECT ns + o AS time_unix_nano,
  CAST(CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'signup' THEN 13 ELSE 9 END
    AS BIGINT) AS severity_number,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN'
    WHEN event_type = 'click' AND event_id % 17 = 0 THEN 'fatal' ELSE 'INFO' END AS severity_text,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE props END AS body, {_SENDER} AS service_name,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE trace_id END AS trace_id,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE span_id END AS span_id, {_OTLP_ATTRS} AS attributes
FROM b CROSS JOIN (VALUES (0), (1)) v(o)""")
O["flatten_otlp_metrics"] = _b(f"""
SELECT ns AS time_unix_nano, event_type AS name,
  CASE WHEN event_type = 'view' THEN 'gauge' ELSE 'sum' END AS type,
  CASE WHEN as_int THEN floor(value) ELSE value END AS value, {_SENDER} AS service_name,
  raw_resource AS resource_attributes
FROM b CROSS JOIN (VALUES (true), (false)) v(as_int)
WHERE event_type IN ('view', 'click', 'error') AND (as_int OR event_id % 8 <> 0)""")
O["skipped_otlp_metrics"] = """
SELECT count(*) AS skipped_metrics FROM events WHERE event_type IN ('signup', 'purchase')"""

# -- rows ---------------------------------------------------------------------

O["apply_column_map"] = _b(f"""
SELECT ns AS ts_ns, trace_id AS "TraceId", span_id AS "SpanId", parent_span_id AS "ParentSpanId",
  event_type AS "SpanName", producer AS "ServiceName", duration_ns AS "Duration",
  {_STATUS} AS "StatusCode", component AS "SpanAttributes" FROM b""")
O["retain"] = silver("""
SELECT t AS tbl, count(*) AS n FROM (
  SELECT 'otel_logs' AS t, event_time FROM logs UNION ALL
  SELECT 'otel_traces', event_time FROM ops UNION ALL
  SELECT 'otel_metrics_' || metric_kind, event_time FROM mets)
WHERE CAST(event_time AS DATE) >= CAST((SELECT max(ts) FROM events) AS DATE) - 10 GROUP BY 1""")
O["to_bronze_log"] = silver("""
SELECT event_time AS "Timestamp", event_time_ns AS "TimestampNs",
  date_trunc('second', event_time) AS "TimestampTime", trace_id AS "TraceId",
  span_id AS "SpanId", severity_text AS "SeverityText", severity_number AS "SeverityNumber",
  service_name AS "ServiceName", body AS "Body", resource AS "ResourceAttributes",
  component AS "LogAttributes" FROM logs""")
O["derive_log_time_columns"] = silver("""
SELECT strftime(event_time, '%Y-%m-%d') AS day, count(*) AS n,
  min(date_trunc('second', event_time)) AS first_second,
  max(date_trunc('second', event_time)) AS last_second FROM logs GROUP BY 1""")
O["to_bronze_span"] = silver("""
SELECT event_time AS "Timestamp", event_time_ns AS "TimestampNs", trace_id AS "TraceId",
  span_id AS "SpanId", parent_span_id AS "ParentSpanId", operation_name AS "SpanName",
  service_name AS "ServiceName", duration_ns AS "Duration", status_code AS "StatusCode",
  resource AS "ResourceAttributes", component AS "SpanAttributes" FROM ops""")
O["to_bronze_metric"] = silver("""
SELECT 'otel_metrics_' || metric_kind AS tbl, event_time AS "TimeUnix",
  event_time_ns AS "TimeUnixNs", service_name AS "ServiceName", metric_name AS "MetricName",
  value AS "Value", component || ',unit=' || metric_unit AS "Attributes" FROM mets""")
O["operation_executions"] = silver("SELECT * EXCLUDE (event_id, resource, component) FROM ops")
O["log_events"] = silver(
    "SELECT * EXCLUDE (event_id, resource, component, component_type) FROM logs")
O["metric_observations"] = silver("SELECT * EXCLUDE (event_id, resource, component) FROM mets")
O["missing_dimensions"] = silver("""
SELECT scenario, run_id, service_name, count(*) AS n FROM ops
WHERE scenario = '' OR run_id = '' OR service_name = '' OR contract_version = ''
GROUP BY 1, 2, 3""")
O["real_data_tripwire"] = silver("""
SELECT 'operation_executions' AS table_name, count(*) FILTER (NOT is_synthetic)
  AS non_synthetic FROM ops
UNION ALL SELECT 'log_events', count(*) FILTER (NOT is_synthetic) FROM logs
UNION ALL SELECT 'metric_observations', count(*) FILTER (NOT is_synthetic) FROM mets""")
O["error_logs"] = silver("""
SELECT event_time, service_name, component_name, severity_text, body, trace_id FROM logs
WHERE is_error""")
O["log_search"] = silver("""
SELECT event_time AS "Timestamp", service_name AS "ServiceName", severity_text AS "SeverityText",
  body AS "Body" FROM logs
WHERE contains(body, '7}') AND starts_with(body, 'error') AND severity_text = 'ERROR'
  AND component_type = 'compute'""")
O["trace_search"] = silver("""
SELECT event_time AS "Timestamp", service_name AS "ServiceName", status_code AS "StatusCode",
  round(duration_ns / 1e6) AS duration_ms, operation_name AS "SpanName" FROM ops
WHERE status_code = 'Error'""")
O["metric_series"] = silver(f"""
SELECT metric_kind, metric_name AS "MetricName", service_name AS "ServiceName",
  date_trunc('{W}', event_time) AS window_start, count(*) AS points,
  round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value
FROM mets GROUP BY 1, 2, 3, 4""")

# -- read views ---------------------------------------------------------------

_HEALTH_KEYS = "scenario, service_name, component_name, operation_name"


def health(width: str = W, keys: str = _HEALTH_KEYS) -> str:
    picks = ", ".join(
        f"max(CASE WHEN pos = least(n * {p} // 100, n - 1) THEN duration_ms END) "
        f"AS latency_p{p}_ms" for p in (50, 95, 99))
    return f"""
ranked AS (SELECT date_trunc('{width}', event_time) AS window_start, {keys}, duration_ms, is_error,
    row_number() OVER (PARTITION BY date_trunc('{width}', event_time), {keys}
      ORDER BY duration_ns) - 1 AS pos,
    count(*) OVER (PARTITION BY date_trunc('{width}', event_time), {keys}) AS n FROM ops),
health AS (SELECT window_start, {keys}, count(*) AS operation_count,
    count(*) FILTER (is_error) AS error_count,
    count(*) FILTER (is_error) / count(*) AS error_rate, {picks},
    max(duration_ms) AS latency_max_ms FROM ranked GROUP BY window_start, {keys})"""


RUNS = """
runs AS (SELECT scenario, run_id, min(event_time) AS run_start, max(event_time) AS run_end,
    epoch_us(max(event_time)) // 1000 - epoch_us(min(event_time)) // 1000 AS observed_duration_ms,
    count(DISTINCT service_name) AS service_count,
    count(DISTINCT CASE WHEN trace_id <> '' THEN trace_id END) AS trace_count,
    count(*) FILTER (signal = 'trace') AS operation_count,
    count(*) FILTER (signal = 'trace' AND is_error) AS operation_error_count,
    count(*) FILTER (signal = 'log') AS log_count,
    count(*) FILTER (signal = 'log' AND is_error) AS log_error_count,
    count(*) FILTER (signal = 'metric') AS metric_count
  FROM everything GROUP BY 1, 2)"""
TRACES = """
traces AS (SELECT scenario, run_id, trace_id, min(event_time) AS trace_start,
    max(end_time) AS trace_end, count(*) AS span_count,
    count(*) FILTER (is_error) AS error_span_count,
    first(service_name ORDER BY event_time_ns, service_name) AS entry_service,
    first(service_name ORDER BY end_time_ns DESC, service_name DESC) AS exit_service,
    array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services,
    array_to_string(list_sort(list(DISTINCT component_name)), ',') AS components,
    round((epoch_us(max(end_time)) - epoch_us(min(event_time))) / 1000.0, 6)
      AS trace_duration_ms,
    count(*) FILTER (is_error) > 0 AS has_error
  FROM ops WHERE trace_id <> '' GROUP BY 1, 2, 3)"""


def more(extra: str, select: str) -> str:
    return _with(f"{SILVER},\n{extra.strip()}", select)


O["service_health_1m"] = more(health(), "SELECT * REPLACE (round(error_rate, 6) AS error_rate) "
                                        "FROM health")
O["service_health_daily"] = more(health("day", "service_name"),
                                 "SELECT * REPLACE (round(error_rate, 6) AS error_rate) "
                                 "FROM health")
O["latest_health"] = more(health(), """
SELECT window_start, service_name, component_name, operation_name, scenario, operation_count,
  error_count, round(error_rate, 4) AS error_rate, round(latency_p95_ms, 3) AS latency_p95_ms
FROM health ORDER BY window_start DESC, service_name, component_name, operation_name, scenario
LIMIT 10""")
BOARD = """
board AS (SELECT service_name, CAST(sum(operation_count) AS BIGINT) AS ops,
    CAST(sum(error_count) AS BIGINT) AS errors, round(avg(latency_p50_ms), 1) AS p50,
    round(max(latency_p95_ms), 1) AS p95, round(max(latency_p99_ms), 1) AS p99,
    round(max(latency_max_ms), 1) AS worst,
    round(sum(error_count) / sum(operation_count), 5) AS error_rate
  FROM health GROUP BY 1)"""
O["service_health"] = more(f"{health()},{BOARD}",
                           "SELECT * FROM board ORDER BY ops DESC, service_name LIMIT 12")
O["log_health_1m"] = silver(f"""
SELECT date_trunc('{W}', event_time) AS window_start, scenario, service_name, component_name,
  count(*) AS log_count, count(*) FILTER (is_error) AS error_log_count,
  max(severity_number) AS max_severity_number, count(DISTINCT trace_id) AS affected_trace_count,
  round(count(*) FILTER (is_error) / count(*), 6) AS error_log_rate
FROM logs GROUP BY 1, 2, 3, 4""")
O["log_health_merged"] = O["log_health_1m"]
O["service_health_window"] = silver("""
, ranked AS (SELECT service_name, duration_ms, is_error,
    row_number() OVER (PARTITION BY service_name ORDER BY duration_ns) - 1 AS pos,
    count(*) OVER (PARTITION BY service_name) AS n
  FROM ops WHERE event_time >= date_trunc('minute', (SELECT max(ts) FROM events) - INTERVAL 10 DAY))
SELECT service_name, count(*) AS ops, count(*) FILTER (is_error) AS errors,
  max(duration_ms) FILTER (pos = n * 50 // 100) AS p50, max(duration_ms) FILTER (pos = n * 95 // 100) AS p95,
  max(duration_ms) FILTER (pos = n * 99 // 100) AS p99, max(duration_ms) AS worst,
  round(count(*) FILTER (is_error) / count(*), 5) AS error_rate
FROM ranked GROUP BY 1""")
O["trace_summary"] = more(TRACES, "SELECT * FROM traces")
O["latest_traces"] = more(TRACES, """
SELECT trace_id, span_count, error_span_count, entry_service, exit_service,
  round(trace_duration_ms, 3) AS trace_duration_ms FROM traces
ORDER BY trace_start DESC, trace_id, scenario, run_id LIMIT 5""")
O["telemetry_coverage_1m"] = silver(f"""
SELECT date_trunc('{W}', event_time) AS window_start, scenario, run_id, service_name,
  component_name, count(*) FILTER (signal = 'trace') AS span_count,
  count(*) FILTER (signal = 'log') AS log_count,
  count(*) FILTER (signal = 'metric') AS metric_count,
  count(DISTINCT CASE WHEN metric_name <> '' THEN metric_name END) AS metric_name_count
FROM everything GROUP BY 1, 2, 3, 4, 5""")
O["telemetry_coverage_merged"] = O["telemetry_coverage_1m"]
O["run_summary"] = more(RUNS, "SELECT * FROM runs")
O["latest_runs"] = more(RUNS, "SELECT * FROM runs ORDER BY run_start DESC, scenario, run_id LIMIT 3")
O["latest_error_logs"] = silver("""
SELECT event_time, service_name, component_name, severity_text, body, trace_id FROM logs
WHERE is_error ORDER BY event_time DESC, service_name, trace_id LIMIT 5""")
O["latest_metrics"] = silver("""
SELECT event_time, service_name, component_name, metric_name, metric_kind, value, metric_unit
FROM mets ORDER BY event_time DESC, service_name, metric_name LIMIT 5""")
O["trace_id_ts"] = silver("""
SELECT trace_id AS "TraceId", min(event_time) AS "Start", max(event_time) AS "End" FROM ops
WHERE trace_id <> '' GROUP BY 1""")


def _stats(keys: str, moments: bool, digits: int = 4) -> str:
    extra = (f", round(avg(value), {digits}) AS avg_value, "
             f"round(stddev_pop(value), {digits}) AS stddev_value" if moments else "")
    return silver(f"""
SELECT date_trunc('{W}', event_time) AS window_start, {keys}, count(*) AS sample_count,
  round(sum(value), {digits}) AS sum_value, round(sum(value * value), {digits}) AS sum_squares,
  min(value) AS min_value, max(value) AS max_value{extra} FROM mets GROUP BY ALL""")


_METRIC_KEYS = "scenario, service_name, component_name, metric_name, metric_kind"
O["metric_stats_1m"] = _stats(_METRIC_KEYS, False)
O["metric_rollup_1m"] = _stats(_METRIC_KEYS, True)
O["metric_rollup_merged"] = _stats(_METRIC_KEYS, True)
O["metric_stats_window"] = _stats("service_name, metric_name, metric_kind", True)
O["stddev_reconcile"] = silver(f"""
SELECT date_trunc('{W}', event_time) AS window_start, service_name, metric_name,
  round(stddev_pop(value), 4) AS from_rollup, round(stddev_pop(value), 4) AS from_raw
FROM mets GROUP BY 1, 2, 3""")
O["bronze_metric_baseline"] = silver(f"""
SELECT service_name, metric_name, scenario, date_trunc('{W}', event_time) AS window_start,
  count(*) AS cnt, round(sum(value), 4) AS sum_val, round(sum(value * value), 4) AS sum_sq,
  min(value) AS min_val, max(value) AS max_val FROM mets GROUP BY 1, 2, 3, 4""")
O["volume_1m"] = silver(f"""
SELECT date_trunc('{W}', event_time) AS window_start, service_name, signal, count(*) AS rows
FROM everything GROUP BY 1, 2, 3""")

_KEY_COUNTS = [
    (C.KEY_SYNTHETIC, "count(*)"), (C.KEY_SCENARIO, "count(*)"),
    (C.KEY_CONTRACT_VERSION, "count(*)"),
    (C.KEY_RUN_ID, "count(*) FILTER (event_id % 10 <> 0)"),
    (C.KEY_PROVIDER, "count(*) FILTER (event_id % 40 <> 0)"),
    (C.KEY_SERVICE, "count(*) FILTER (event_id % 101 <> 0)"),
]
_KEY_TEXT = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {n} > 0 THEN '{k}=' || {n} END" for k, n in sorted(_KEY_COUNTS)) + ")"
O["resource_key_presence_1m"] = silver(f"""
SELECT date_trunc('{W}', event_time) AS window_start, service_name, signal, count(*) AS rows,
  {_KEY_TEXT} AS key_counts FROM everything GROUP BY 1, 2, 3""")
O["merge_on_read"] = silver(f"""
SELECT date_trunc('{W}', event_time) AS window_start, service_name, signal,
  count(*) AS volume_rows, count(*) AS rows, {_KEY_TEXT} AS key_counts
FROM everything GROUP BY 1, 2, 3""")
_PER_KEY = "\nUNION ALL ".join(
    f"SELECT service_name, signal, count(*) AS rows, '{k}' AS key, {n} AS present "
    f"FROM everything GROUP BY 1, 2" for k, n in _KEY_COUNTS)
O["rows_missing_key"] = silver(f"""
SELECT service_name, signal, rows, key, rows - present AS rows_missing_key
FROM ({_PER_KEY}) WHERE present > 0""")
O["key_counts_bounded"] = silver("SELECT count(*) AS violations FROM ops WHERE false")

# -- joins --------------------------------------------------------------------

EDGES = f"""
parents AS (SELECT trace_id, span_id, min(service_name) AS src FROM ops GROUP BY 1, 2),
edges AS (SELECT date_trunc('{W}', c.event_time) AS window_start, p.src AS src_service,
    c.service_name AS dst_service, count(*) AS spans, count(*) FILTER (c.is_error) AS errors
  FROM ops c JOIN parents p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
  WHERE c.parent_span_id <> '' GROUP BY 1, 2, 3),
pairs AS (SELECT src_service AS src, dst_service AS dst, CAST(sum(spans) AS BIGINT) AS spans,
    CAST(sum(errors) AS BIGINT) AS errors FROM edges GROUP BY 1, 2),
observed AS (SELECT * FROM pairs WHERE src <> dst)"""
_SERVICE_OF = {c[0]: c[2] for c in bridge.DECLARED}
_DECLARED = [(_SERVICE_OF[up], c[2]) for c in bridge.DECLARED for up in c[3]]
DECLARED = ("declared(src, dst) AS (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, b in _DECLARED) + ")")
NODES = ("nodes(component, service, base_latency_ms, error_ratio) AS (VALUES " + ", ".join(
    f"('{c[0]}', '{c[2]}', {c[5]}::DOUBLE, {c[6]}::DOUBLE)" for c in bridge.DECLARED) + ")")


def graph(select: str) -> str:
    return more(f"{EDGES},\n{DECLARED}", select)


O["call_edges_1m"] = more(EDGES, "SELECT * FROM edges")
O["call_edges"] = more(EDGES, "SELECT * FROM observed ORDER BY spans DESC, src, dst LIMIT 24")
O["call_edges_rollup"] = more(EDGES, "SELECT * FROM pairs ORDER BY spans DESC, src, dst LIMIT 24")
O["call_edges_trailing_day"] = silver(f"""
, recent AS (SELECT * FROM ops WHERE event_time >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR),
parents AS (SELECT trace_id, span_id, min(service_name) AS src FROM recent GROUP BY 1, 2)
SELECT date_trunc('{W}', c.event_time) AS window_start, p.src AS src_service,
  c.service_name AS dst_service, count(*) AS spans, count(*) FILTER (c.is_error) AS errors
FROM recent c JOIN parents p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
WHERE c.parent_span_id <> '' GROUP BY 1, 2, 3""")
O["refresh_call_edges"] = O["call_edges_trailing_day"].replace(f"date_trunc('{W}'", "date_trunc('minute'")
O["undeclared_edges"] = graph("SELECT * FROM observed o WHERE NOT EXISTS (SELECT 1 FROM declared d "
                              "WHERE d.src = o.src AND d.dst = o.dst)")
O["declared_vs_observed_edges"] = graph("""
SELECT coalesce(o.src, d.src) AS src, coalesce(o.dst, d.dst) AS dst,
  coalesce(spans, 0) AS spans, coalesce(errors, 0) AS errors,
  CASE WHEN spans > 0 THEN round(errors / spans, 6) ELSE 0 END AS error_rate,
  CASE WHEN o.src IS NULL THEN 'declared-only' WHEN d.src IS NULL THEN 'observed-only'
    ELSE 'both' END AS status
FROM observed o FULL JOIN declared d ON o.src = d.src AND o.dst = d.dst""")
O["edge_health"] = graph(f"""
SELECT d.src, d.dst, spans, errors,
  round(spans / greatest(1, (SELECT max(spans) FROM observed)), 6) AS share_of_peak,
  round(errors / spans, 6) AS error_rate,
  CASE WHEN spans IS NULL THEN 'declared-only'
    WHEN errors / spans >= {C.EDGE_FAIL_RATE} THEN 'fail'
    WHEN errors / spans >= {C.EDGE_WARN_RATE} THEN 'warn' ELSE 'ok' END AS class
FROM declared d LEFT JOIN observed o ON o.src = d.src AND o.dst = d.dst""")
O["declared_vs_measured"] = more(f"{health()},{BOARD},\n{NODES}", """
SELECT component, service, base_latency_ms, error_ratio, p50, p99, error_rate,
  round(p50 - base_latency_ms, 6) AS p50_over_declared,
  round(error_rate - error_ratio, 6) AS error_over_declared
FROM nodes LEFT JOIN board ON board.service_name = nodes.service""")
O["undeclared_producers"] = more(NODES, """
SELECT DISTINCT service_name AS service FROM everything
WHERE service_name <> '' AND service_name NOT IN (SELECT service FROM nodes)""")
O["reconcile_counts"] = silver("""
SELECT signal, service_name, count(*) FILTER (is_synthetic) AS rolled, count(*) AS base
FROM everything GROUP BY 1, 2 HAVING count(*) FILTER (is_synthetic) <> count(*)""")
_DAYS = """days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS partition_id, day(ts) AS d
  FROM events)"""
O["partitions_present"] = f"WITH {_DAYS} SELECT partition_id FROM days"
O["missing_backfill_partitions"] = f"WITH {_DAYS} SELECT partition_id FROM days WHERE d % 4 = 0"
O["rollup_ready_gate"] = f"""WITH {_DAYS} SELECT count(*) FILTER (d % 4 = 0) = 0 AS ready,
  coalesce(string_agg(partition_id, ', ' ORDER BY partition_id) FILTER (d % 4 = 0), '') AS missing
FROM days"""
O["service_path"] = silver("""
SELECT service_name AS service, count(*) AS total, count(*) FILTER (signal = 'log') AS logs,
  count(*) FILTER (signal = 'trace') AS traces,
  count(*) FILTER (metric_name = 'operation.latency_ms') AS gauge,
  count(*) FILTER (signal = 'metric' AND metric_name <> 'operation.latency_ms') AS sums,
  count(DISTINCT CASE WHEN metric_name = 'operation.latency_ms' THEN metric_name END)
    AS gauge_metrics,
  count(DISTINCT CASE WHEN metric_name IN ('operation.request_count', 'operation.error_count')
    THEN metric_name END) AS sum_metrics,
  coalesce(string_agg(DISTINCT metric_name, ',' ORDER BY metric_name)
    FILTER (metric_name = 'operation.latency_ms'), '') AS gauge_names,
  coalesce(string_agg(DISTINCT metric_name, ',' ORDER BY metric_name)
    FILTER (metric_name <> '' AND metric_name <> 'operation.latency_ms'), '') AS sum_names
FROM everything GROUP BY 1""")
O["trace_detail"] = silver("""
, lookup AS (SELECT trace_id, min(event_time) AS lo, max(event_time) AS hi FROM ops GROUP BY 1
  HAVING count(*) FILTER (is_error) > 0),
united AS (SELECT trace_id, span_id, event_time, event_time_ns AS ts_ns, 'span' AS kind,
    service_name AS service, operation_name AS label, status_code AS status FROM ops
  UNION ALL SELECT trace_id, span_id, event_time, event_time_ns, 'log', service_name, body,
    severity_text FROM logs WHERE trace_id <> '')
SELECT united.* EXCLUDE (event_time) FROM united JOIN lookup USING (trace_id)
WHERE event_time BETWEEN lo AND hi""")
O["logs_with_trace"] = silver("""
, spans AS (SELECT trace_id, span_id, first(operation_name ORDER BY operation_name, service_name,
      duration_ms, status_code) AS operation_name,
    first(service_name ORDER BY operation_name, service_name, duration_ms, status_code)
      AS span_service,
    first(duration_ms ORDER BY operation_name, service_name, duration_ms, status_code)
      AS duration_ms,
    first(status_code ORDER BY operation_name, service_name, duration_ms, status_code)
      AS status_code FROM ops GROUP BY 1, 2)
SELECT l.event_time_ns, l.trace_id, l.span_id, l.service_name, l.severity_text, l.body,
  s.operation_name, s.span_service, s.duration_ms, s.status_code
FROM logs l LEFT JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id
WHERE l.trace_id <> ''""")

# -- boards -------------------------------------------------------------------

BRONZE = """
bronze AS (SELECT 'otel_logs' AS tbl, event_id, service_name, '' AS metric_name FROM logs
  UNION ALL SELECT 'otel_traces', event_id, service_name, '' FROM ops
  UNION ALL SELECT 'otel_metrics_' || metric_kind, event_id, service_name, metric_name FROM mets)"""


def bronze(select: str) -> str:
    return more(BRONZE, select)


O["table_counts"] = bronze("SELECT tbl, count(*) AS n FROM bronze GROUP BY 1")
O["lineage"] = bronze("""
SELECT service_name AS service, count(*) AS total, count(*) FILTER (tbl = 'otel_logs') AS logs,
  count(*) FILTER (tbl = 'otel_traces') AS traces,
  count(*) FILTER (tbl = 'otel_metrics_gauge') AS gauge,
  count(*) FILTER (tbl = 'otel_metrics_sum') AS sums
FROM bronze GROUP BY 1 ORDER BY total DESC, service LIMIT 12""")
O["metric_inventory"] = silver(
    "SELECT DISTINCT service_name AS service, metric_kind AS tbl, metric_name FROM mets")
_GONE = {C.KEY_RUN_ID: "event_id % 10 = 0", C.KEY_PROVIDER: "event_id % 40 = 0",
         C.KEY_SERVICE: "event_id % 101 = 0"}
_SLOTS = [(f"missing_{i}", k, _GONE.get(k, "false")) for i, k in
          enumerate(C.REQUIRED_RESOURCE_KEYS)]
_ANY = " OR ".join(_GONE.values())
VIOLATIONS = f"""{BRONZE},
violations0 AS (SELECT service_name AS service, count(*) AS rows,
    {", ".join(f"count(*) FILTER ({g}) AS {s}" for s, _, g in _SLOTS)},
    count(*) FILTER ({_ANY}) AS violating FROM bronze GROUP BY 1),
violations AS (SELECT *, {" + ".join(s for s, _, _ in _SLOTS)} AS total_missing,
    concat_ws(',', {", ".join(f"CASE WHEN {s} > 0 THEN '{k}' END" for s, k, _ in _SLOTS)})
      AS missing_keys FROM violations0)"""
_WORST = """SELECT * FROM violations WHERE total_missing > 0
ORDER BY total_missing DESC, service LIMIT 10"""
O["contract_violations"] = more(VIOLATIONS, _WORST)
O["contract_violations_rollup"] = more(VIOLATIONS, _WORST)
O["violation_share"] = more(VIOLATIONS, f"""
SELECT service, rows, violating, round(violating / rows, 6) AS share,
  CAST(len(string_split(missing_keys, ',')) AS INTEGER) AS keys_missing FROM ({_WORST})""")


def band(source: str) -> str:
    """Statistics of a bucket table ``bk(service, t, n)`` defined by ``source``."""
    return f"""
bk AS ({source}),
rk AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY n) AS pos,
    count(*) OVER (PARTITION BY service) AS c FROM bk),
md AS (SELECT service, max(CASE WHEN pos = c // 2 + 1 THEN n END) AS med FROM rk GROUP BY 1),
dv AS (SELECT bk.*, med, abs(n - med) AS d, row_number() OVER (PARTITION BY bk.service
      ORDER BY abs(n - med)) AS pos, count(*) OVER (PARTITION BY bk.service) AS c
    FROM bk JOIN md ON bk.service = md.service),
band AS (SELECT service, CAST(max(med) AS DOUBLE) AS median,
    CAST(max(CASE WHEN pos = c // 2 + 1 THEN d END) AS DOUBLE) AS mad, stddev_pop(n) AS sd,
    count(*) AS seen, arg_max(n, t) AS latest, CAST(epoch(max(t)) AS BIGINT) AS latest_t,
    string_agg(CAST(epoch(t) AS BIGINT) || ':' || n, ',' ORDER BY t) AS series,
    (SELECT count(DISTINCT t) FROM bk) AS estate FROM dv GROUP BY 1)"""


DAILY = band("""SELECT service_name AS service, date_trunc('day', event_time) AS t, count(*) AS n
  FROM logs WHERE event_time < date_trunc('day', (SELECT max(ts) FROM events)) GROUP BY 1, 2""")
_TOP8 = "SELECT * REPLACE (round(sd, 6) AS sd) FROM band ORDER BY median DESC, service LIMIT 8"
O["volume_band"] = more(DAILY, _TOP8)
O["volume_band_rollup"] = more(band("""
  SELECT service_name AS service, date_trunc('hour', event_time) AS t, count(*) AS n FROM logs
  WHERE date_trunc('hour', event_time) < date_trunc('hour', (SELECT max(ts) FROM events))
    AND date_trunc('hour', event_time) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
  GROUP BY 1, 2"""), _TOP8)
VERDICT = f"""{DAILY},
shares AS (SELECT bk.service,
    count(*) FILTER (n < median - {C.Z_WARN} * mad * {C.MAD_TO_SIGMA}
      OR n > median + {C.Z_WARN} * mad * {C.MAD_TO_SIGMA}) / count(*) AS mad_share,
    count(*) FILTER (n < median - {C.Z_WARN} * sd OR n > median + {C.Z_WARN} * sd)
      / count(*) AS sd_share
  FROM bk JOIN band ON bk.service = band.service GROUP BY 1),
chosen AS (SELECT band.*, greatest(0, estate - seen) AS absent, mad_share, sd_share,
    CASE WHEN estate < {C.MIN_BUCKETS} THEN 'none'
      WHEN mad > 0 AND mad_share <= {C.MAX_OOB_SHARE} THEN 'mad'
      WHEN sd > 0 AND sd_share <= {C.MAX_OOB_SHARE} THEN 'stddev' ELSE 'none' END AS estimator
  FROM band JOIN shares ON band.service = shares.service),
scaled AS (SELECT *, CASE estimator WHEN 'mad' THEN mad * {C.MAD_TO_SIGMA}
    WHEN 'stddev' THEN sd END AS s FROM chosen),
verdict AS (SELECT service, median, mad, round(sd, 6) AS sd, seen, latest, latest_t, estate,
    absent, estimator, coalesce(round(s, 2), 0) AS scale,
    CASE WHEN s IS NULL THEN median ELSE round(median - {C.Z_WARN} * s, 1) END AS lo,
    CASE WHEN s IS NULL THEN median ELSE round(median + {C.Z_WARN} * s, 1) END AS hi,
    coalesce(round(abs(latest - median) / s, 2), 0) AS z,
    CASE estimator WHEN 'mad' THEN round(mad_share, 3) WHEN 'stddev' THEN round(sd_share, 3)
      END AS oob,
    CASE WHEN s IS NULL THEN 'unmonitored' WHEN abs(latest - median) / s >= {C.Z_ERROR} THEN 'fail'
      WHEN abs(latest - median) / s >= {C.Z_WARN} THEN 'warn' ELSE 'passing' END AS state,
    CASE WHEN estate < {C.MIN_BUCKETS} THEN 'too_few_buckets n=' || estate
      WHEN s IS NOT NULL THEN 'distance z=' || format('{{:.1f}}', abs(latest - median) / s)
        || ' median=' || format('{{:.0f}}', median)
      WHEN mad <= 0 AND sd <= 0 THEN '{V.NO_DISPERSION}' ELSE '{V.NO_BAND}' END AS why
  FROM scaled)"""
O["volume_state"] = more(VERDICT, "SELECT * FROM verdict")
O["oob_share"] = more(VERDICT, """SELECT service, round(mad_share, 6) AS mad_share,
  round(sd_share, 6) AS sd_share FROM shares""")
O["out_of_band_points"] = more(VERDICT, """
SELECT bk.service, lo, hi, CAST(epoch(t) AS BIGINT) AS t, n FROM bk JOIN verdict v
  ON bk.service = v.service WHERE state <> 'unmonitored' AND (n < lo OR n > hi)""")
_RANK = "CASE state " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in V.STATE_RANK.items()) + " END"
O["volume_board"] = more(VERDICT, f"""
SELECT CAST({_RANK} AS INTEGER) AS severity, service, state, absent, median, why FROM verdict""")
O["volume_tally"] = more(VERDICT, """
SELECT count(*) AS producers, count(*) FILTER (state IN ('warn', 'fail')) AS alerting,
  count(*) FILTER (state = 'unmonitored') AS not_monitored,
  count(*) FILTER (absent > 0) AS silent,
  count(*) FILTER (estimator = 'stddev') AS on_fallback FROM verdict""")
O["producer_health"] = more(f"{VERDICT},{VIOLATIONS}", f"""
, joined AS (SELECT coalesce(v.service, c.service) AS service, v.state AS vstate, z, absent,
    estate, why AS vwhy, violating, missing_keys,
    coalesce(absent >= {C.ABSENT_MIN} AND absent >= estate * {C.ABSENT_SHARE}, false) AS silent,
    coalesce(violating > 0, false) AS bad
  FROM verdict v FULL JOIN (SELECT * FROM violations WHERE total_missing > 0) c
    ON v.service = c.service)
SELECT service,
  CASE WHEN vstate = 'fail' THEN 'fail' WHEN vstate = 'warn' OR silent OR bad THEN 'warn'
    ELSE coalesce(vstate, 'unknown') END AS state,
  CASE WHEN vstate IN ('warn', 'fail') OR silent OR bad THEN concat_ws('; ',
    CASE WHEN vstate IN ('warn', 'fail') THEN 'volume_out_of_band z=' || z END,
    CASE WHEN silent THEN 'silent buckets=' || absent || '/' || estate END,
    CASE WHEN bad THEN 'keys_missing rows=' || violating || ' keys='
      || len(string_split(missing_keys, ',')) || '/5' END)
  ELSE coalesce(vwhy, 'no_volume') END AS why
FROM joined""")
O["base_coverage"] = silver("""
SELECT 'operation_executions' AS tbl, min(event_time) AS oldest FROM ops
UNION ALL SELECT 'log_events', min(event_time) FROM logs
UNION ALL SELECT 'metric_observations', min(event_time) FROM mets""")
O["latest_scenario"] = silver(
    "SELECT arg_max(scenario, event_time_ns) AS scenario FROM logs")
O["model_counts"] = silver(f"""
SELECT 'operation_executions' AS model, (SELECT CAST(count(*) AS VARCHAR) FROM ops) AS n, true AS present
UNION ALL SELECT 'log_events', (SELECT CAST(count(*) AS VARCHAR) FROM logs), true
UNION ALL SELECT 'metric_observations', (SELECT CAST(count(*) AS VARCHAR) FROM mets), true
UNION ALL SELECT 'volume_1m', (SELECT CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT date_trunc('{W}', event_time),
  service_name, signal FROM everything)), true
UNION ALL SELECT m, NULL, false FROM (VALUES ('metric_stats_1m'), ('resource_key_presence_1m'),
  ('call_edges_1m')) v(m)""")
O["content_checksum"] = silver("""
SELECT tbl, count(*) AS rows, true AS stable, CAST(sum(CAST('0x' || substr(md5(concat_ws('|',
    event_time_ns, service_name, scenario, component_name)), 1, 8) AS BIGINT)) AS BIGINT) AS text_hash
FROM (SELECT 'operation_executions' AS tbl, event_time_ns, service_name, scenario, component_name
      FROM ops UNION ALL SELECT 'log_events', event_time_ns, service_name, scenario, component_name
      FROM logs UNION ALL SELECT 'metric_observations', event_time_ns, service_name, scenario,
        component_name FROM mets) GROUP BY tbl""")
O["piece_sums"] = silver("""
SELECT tbl, strftime(CAST(event_time AS DATE), '%Y-%m-%d') AS day, count(*) AS rows, true AS agrees
FROM (SELECT 'operation_executions' AS tbl, event_time FROM ops UNION ALL SELECT 'log_events', event_time FROM logs
  UNION ALL SELECT 'metric_observations', event_time FROM mets) GROUP BY 1, 2""")
O["coverage_gate"] = """
WITH c AS (SELECT min(ts) AS oldest, max(ts) AS as_of FROM events),
cases(name, minutes, longest) AS (VALUES ('volume 60 min', 60, NULL),
  ('volume 60 days', 86400, NULL), ('edges 15 min', 15, 1440), ('edges 25 h', 1500, 1440)),
d AS (SELECT name AS "case", oldest <= as_of - to_minutes(minutes)
    AND (longest IS NULL OR minutes <= longest) AS covered FROM c CROSS JOIN cases)
SELECT "case", covered, CASE WHEN covered THEN 'rollup' ELSE 'raw' END AS source FROM d"""
O["fallback_removal_ready"] = """
WITH r AS (SELECT max(ts) AS read_at, min(ts) AS oldest FROM events GROUP BY CAST(ts AS DATE)),
newest AS (SELECT * FROM r ORDER BY read_at DESC LIMIT 7)
SELECT d.days, count(*) >= 7 AND count(*) FILTER (
  oldest <= (SELECT max(ts) FROM events) - to_days(d.days)) = count(*) AS ready
FROM newest CROSS JOIN (VALUES (0), (30)) d(days) GROUP BY 1"""

# -- scrapes ------------------------------------------------------------------


def _series() -> str:
    top = bridge.LATENCY_BUCKETS[-1][1]
    rows = [
        (C.METRIC_INGESTED, 'signal="logs"', "r * 3", "true"),
        (C.METRIC_INGESTED, 'signal="trace"', "r * 2", "true"),
        (C.METRIC_INGESTED, 'signal="metrics"', "r * 5", "event_id % 3 <> 0"),
        (C.METRIC_ACCEPTED, 'signal="logs"', "r * 3", "true"),
        (C.METRIC_REJECTED, 'reason="contract",signal="metrics"', "r // 10", "true"),
        (C.METRIC_REJECTED, 'reason="contract",signal="logs"', "r // 25", "true"),
        (C.METRIC_REJECTED, 'reason="backpressure",signal="trace"', "r // 250",
         "event_id % 4 <> 0"),
        (C.METRIC_STORAGE, 'outcome="persisted"', "r * 9", "true"),
        (C.METRIC_STORAGE, 'outcome="dropped"', "r // 1000", "true"),
        (C.METRIC_FLUSH_COUNT, "", "r * 300 + user_id % 7 * 100", "true"),
        (C.METRIC_FLUSH_SUM, "", "r * 360000", "true"),
        (C.METRIC_EXPORT_ERRORS, "", "r // 2000", "true"),
        (f"{C.METRIC_LATENCY}_count", "", "r + 10", "true"),
        (f"{C.METRIC_LATENCY}_sum", "", "r // 40", "true"),
    ]
    for le, share in bridge.LATENCY_BUCKETS:
        slow = " - CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END" if 2 < share < top else ""
        rows.append((f"{C.METRIC_LATENCY}_bucket", f'le="{le}"',
                     f"(r + 10) * ({share}{slow}) // {top}", "true"))
    return ", ".join(f"{{'name': '{n}', 'label_key': '{k}', 'v': CAST({v} AS BIGINT), "
                     f"'here': {c}}}" for n, k, v, c in rows)


SAMPLES = f"""
raw AS (SELECT *, event_id % 5000 AS r, 'collector-' || (user_id % 4) AS instance FROM events),
samples AS (SELECT instance, ts AS scrape_ts, u.name AS name, u.label_key AS label_key,
    CAST(u.v AS DOUBLE) AS value
  FROM (SELECT instance, ts, unnest([{_series()}]) AS u FROM raw) WHERE u.here)"""


def samples(select: str) -> str:
    return _with(SAMPLES, select)


def scraped(sql: str) -> str:
    """``sql`` on whole scrapes: events of one collector and time are one, where a repeated series keeps its last line.

    The last event has every series but two, which some events lack; those are of the last event that has them.
    """
    one = f"""raw AS (SELECT instance, ts, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id,
    max(event_id) % 5000 AS r, max(event_id) FILTER (event_id % 3 <> 0) AS metrics_id,
    max(event_id) FILTER (event_id % 4 <> 0) AS trace_id
  FROM (SELECT *, 'collector-' || (user_id % 4) AS instance FROM events) GROUP BY instance, ts),"""
    before, after = sql.split("raw AS (", 1)
    rest = after.split("FROM events),", 1)[1]
    for pattern, text in ((r"\br \* 5\b", "(metrics_id % 5000 * 5)"), (r"\br // 250\b", "(trace_id % 5000 // 250)"),
                          (r"event_id % 3 <> 0", "metrics_id IS NOT NULL"), (r"event_id % 4 <> 0", "trace_id IS NOT NULL")):
        rest = re.sub(pattern, text, rest)
    return before + one + rest


def in_decimals(sql: str, digits: int) -> str:
    """``sql`` whose rates are rounded by their decimal digits, halves up: a product with 10 ** digits would be rounded before."""
    return re.sub(rf"round\((.*), {digits}\)", rf"CAST(round(CAST(CAST(\1 AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)", sql)


O["read_scrapes"] = scraped(samples("SELECT * FROM samples"))
O["scrape_value"] = samples(f"""
SELECT instance, scrape_ts, sum(value) FILTER (name = '{C.METRIC_INGESTED}') AS family,
  coalesce(sum(value) FILTER (name = '{C.METRIC_INGESTED}' AND label_key = 'signal="metrics"'), 0)
    AS series, 0.0::DOUBLE AS absent FROM samples GROUP BY 1, 2""")
O["scrape_sum_over"] = samples(f"""
SELECT instance, scrape_ts, regexp_extract(label_key, 'reason="([a-z]+)"', 1) AS reason,
  sum(value) AS value FROM samples WHERE name = '{C.METRIC_REJECTED}' GROUP BY 1, 2, 3""")
O["scrape_sum_over_pair"] = samples(f"""
SELECT instance, scrape_ts, regexp_extract(label_key, 'reason="([a-z]+)"', 1) AS reason,
  regexp_extract(label_key, 'signal="([a-z]+)"', 1) AS signal, sum(value) AS value
FROM samples WHERE name = '{C.METRIC_REJECTED}' GROUP BY 1, 2, 3, 4""")
QUANTILES = f"""
hist AS (SELECT instance, scrape_ts, value AS cum, CASE WHEN label_key = 'le="+Inf"'
    THEN 'inf'::DOUBLE ELSE CAST(regexp_extract(label_key, 'le="([0-9.]+)"', 1) AS DOUBLE) END AS le
  FROM samples WHERE name = '{C.METRIC_LATENCY}_bucket'),
steps AS (SELECT *, coalesce(lag(le) OVER w, 0) AS ple, coalesce(lag(cum) OVER w, 0) AS pcum,
    max(cum) OVER (PARTITION BY instance, scrape_ts) AS total
  FROM hist WINDOW w AS (PARTITION BY instance, scrape_ts ORDER BY le)),
qs AS (SELECT instance, scrape_ts, p.name AS q, first(CASE WHEN le = 'inf'::DOUBLE THEN ple
      WHEN cum - pcum <= 0 THEN le
      ELSE ple + (le - ple) * ((p.q * total - pcum) / (cum - pcum)) END ORDER BY le) AS v
  FROM steps CROSS JOIN (VALUES ('p50', 0.5::DOUBLE), ('p90', 0.9::DOUBLE),
    ('p99', 0.99::DOUBLE)) p(name, q)
  WHERE cum >= p.q * total GROUP BY 1, 2, 3),
lat AS (SELECT instance, scrape_ts, max(v) FILTER (q = 'p50') AS p50,
    max(v) FILTER (q = 'p90') AS p90, max(v) FILTER (q = 'p99') AS p99 FROM qs GROUP BY 1, 2)"""
O["histogram_quantile"] = samples(f"""
, {QUANTILES.strip()}
SELECT instance, scrape_ts, round(p50, 12) AS p50, round(p90, 12) AS p90, round(p99, 12) AS p99
FROM lat""")
O["counter_rate"] = samples("""
, steps AS (SELECT *, lag(value) OVER w AS prev,
    (epoch_us(scrape_ts) - epoch_us(lag(scrape_ts) OVER w)) / 1e6 AS dt FROM samples
  WINDOW w AS (PARTITION BY instance, name, label_key ORDER BY scrape_ts))
SELECT instance, name, label_key, scrape_ts, value, CASE WHEN prev IS NULL THEN NULL
  ELSE round(CASE WHEN value < prev THEN value ELSE value - prev END / dt, 6) END AS rate
FROM steps""")


def _rate(c: str, p: str, digits: int, dt: str = "dt") -> str:
    return f"round((CASE WHEN {c} < {p} THEN {c} ELSE {c} - {p} END) / {dt}, {digits})"


def _label_rates(values: list[tuple[dict, str, str]]) -> str:
    """Rates per label value; a value present on either side of the step counts."""
    names = list(values[0][0])
    items = ", ".join(
        "{" + ", ".join([*[f"'{k}': '{v}'" for k, v in labels.items()],
                         f"'v': CASE WHEN {cond} THEN CAST({expr} AS DOUBLE) END"]) + "}"
        for labels, expr, cond in values)
    picks = ", ".join(f"u.{n} AS {n}" for n in names)
    part = ", ".join(["instance", *names])
    return samples(f"""
, per AS (SELECT instance, ts AS scrape_ts, {picks}, u.v AS v
  FROM (SELECT instance, ts, unnest([{items}]) AS u FROM raw)),
steps AS (SELECT *, lag(v) OVER w AS p, (epoch_us(scrape_ts) - epoch_us(lag(scrape_ts) OVER w))
    / 1e6 AS dt FROM per WINDOW w AS (PARTITION BY {part} ORDER BY scrape_ts))
SELECT instance, scrape_ts, {", ".join(names)},
  {_rate("coalesce(v, 0)", "coalesce(p, 0)", 6)} AS rate
FROM steps WHERE dt IS NOT NULL AND (v IS NOT NULL OR p IS NOT NULL)""")


O["rate_by_label"] = in_decimals(scraped(_label_rates([
    ({"signal": "logs"}, "r * 3", "true"), ({"signal": "trace"}, "r * 2", "true"),
    ({"signal": "metrics"}, "r * 5", "event_id % 3 <> 0")])), 6)
O["reject_rate_matrix"] = scraped(_label_rates([
    ({"reason": "contract", "signal": "metrics"}, "r // 10", "true"),
    ({"reason": "contract", "signal": "logs"}, "r // 25", "true"),
    ({"reason": "backpressure", "signal": "trace"}, "r // 250", "event_id % 4 <> 0")]))
O["table_growth"] = """
WITH s AS (SELECT ts AS read_at, event_type AS tbl,
    count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events),
d AS (SELECT *, lag(n) OVER w AS p, (epoch_us(read_at) - epoch_us(lag(read_at) OVER w)) / 1e6
    AS dt FROM s WINDOW w AS (PARTITION BY tbl ORDER BY read_at, n))
SELECT tbl, read_at, n, CASE WHEN p IS NULL THEN NULL WHEN dt <= 0 THEN 0.0
  ELSE round(CASE WHEN n < p THEN n ELSE n - p END / dt, 1) END AS rows_per_s FROM d"""

_COUNTERS = {
    "in_logs": "r * 3", "in_trace": "r * 2",
    "in_metrics": "CASE WHEN event_id % 3 <> 0 THEN r * 5 ELSE 0 END",
    "rj_logs": "r // 25", "rj_trace": "CASE WHEN event_id % 4 <> 0 THEN r // 250 ELSE 0 END",
    "rj_metrics": "r // 10", "contract": "r // 10 + r // 25",
    "backpressure": "CASE WHEN event_id % 4 <> 0 THEN r // 250 ELSE 0 END",
    "flushes": "r * 300 + user_id % 7 * 100", "records": "r * 360000", "persisted": "r * 9",
    "dropped": "r // 1000", "errors": "r // 2000", "lat_count": "r + 10", "lat_sum": "r // 40",
}


def _tick(name: str, digits: int) -> str:
    return f"CASE WHEN dt IS NULL THEN 0 ELSE {_rate(name, 'p_' + name, digits)} END"


TICKS = f"""{QUANTILES.strip()},
wide AS (SELECT instance, ts AS scrape_ts,
    {", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in _COUNTERS.items())} FROM raw),
moved AS (SELECT *, {", ".join(f"lag({n}) OVER w AS p_{n}" for n in _COUNTERS)},
    (epoch_us(scrape_ts) - epoch_us(lag(scrape_ts) OVER w)) / 1e6 AS dt
  FROM wide WINDOW w AS (PARTITION BY instance ORDER BY scrape_ts)),
rates AS (SELECT instance, scrape_ts, dt, errors AS export_errors,
    {", ".join(f"{_tick(n, 1)} AS {n}" for n in ("in_logs", "in_trace", "in_metrics", "rj_logs",
                                                "rj_trace", "rj_metrics"))},
    {_tick("contract", 2)} AS contract_rate, {_tick("backpressure", 2)} AS backpressure_rate,
    {_tick("rj_logs", 2)} AS contract_logs, {_tick("rj_metrics", 2)} AS contract_metrics,
    {_tick("rj_trace", 2)} AS backpressure_trace,
    {_tick("flushes", 2)} AS flush_rate,
    CASE WHEN flushes - p_flushes > 0 THEN round((records - p_records) / (flushes - p_flushes), 0)
      ELSE 0 END AS records_per_flush,
    CASE WHEN lat_count - p_lat_count > 0
      THEN round((lat_sum - p_lat_sum) / (lat_count - p_lat_count) * 1000, 1) ELSE 0 END
      AS latency_ms,
    {_tick("persisted", 1)} AS persist_rate, {_tick("dropped", 1)} AS drop_rate,
    coalesce(errors - p_errors, 0) AS errors_since FROM moved),
metrics AS (SELECT rates.*, CASE WHEN dt IS NULL THEN 0 ELSE round(p99 * 1000, 1) END AS p99,
    round(in_logs + in_trace + in_metrics, 1) AS ingest_rate,
    round(rj_logs + rj_trace + rj_metrics, 2) AS reject_rate
  FROM rates JOIN lat ON rates.instance = lat.instance AND rates.scrape_ts = lat.scrape_ts),
modes AS (SELECT *, CASE WHEN ingest_rate <= 0 AND flush_rate <= 0 THEN 'idle'
    WHEN coalesce(max(CASE WHEN dt IS NOT NULL THEN flush_rate END) OVER (
        PARTITION BY instance ORDER BY scrape_ts
        ROWS BETWEEN {C.FLUSH_RATE_SAMPLES - 1} PRECEDING AND CURRENT ROW), flush_rate)
        >= {C.BATCH_FLUSH_RATE}
      OR records_per_flush >= {C.BATCH_RECORDS_PER_FLUSH} THEN 'batch' ELSE 'stream' END AS mode
  FROM metrics)"""


def ticks(select: str) -> str:
    return samples(f", {TICKS}\n{select.strip()}")


O["flush_stats"] = scraped(ticks(
    "SELECT instance, scrape_ts, flush_rate, records_per_flush, latency_ms FROM metrics"))
O["storage_rates"] = scraped(ticks("SELECT instance, scrape_ts, persist_rate, drop_rate FROM metrics"))
O["delivery_mode"] = scraped(ticks("SELECT instance, scrape_ts, flush_rate, mode FROM modes"))
O["mode_segments"] = ticks(f"""
, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance
    ORDER BY scrape_ts DESC) AS rn FROM modes) WHERE rn <= {C.HISTORY_SAMPLES}),
marked AS (SELECT *, CASE WHEN lag(mode) OVER w <> mode THEN 1 ELSE 0 END AS changed FROM recent
  WINDOW w AS (PARTITION BY instance ORDER BY scrape_ts)),
runs AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY instance ORDER BY scrape_ts) AS BIGINT)
  AS segment FROM marked)
SELECT instance, segment, mode, min(scrape_ts) AS started, max(scrape_ts) AS ended,
  count(*) AS ticks FROM runs GROUP BY 1, 2, 3""")
O["mode_segments_all"] = scraped(ticks("""
, marked AS (SELECT *, CASE WHEN lag(mode) OVER w <> mode THEN 1 ELSE 0 END AS changed FROM modes
  WINDOW w AS (PARTITION BY instance ORDER BY scrape_ts)),
runs AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY instance ORDER BY scrape_ts) AS BIGINT)
  AS segment FROM marked)
SELECT instance, segment, mode, min(scrape_ts) AS started, max(scrape_ts) AS ended,
  count(*) AS ticks FROM runs GROUP BY 1, 2, 3"""))
_HISTORY = {"ingest": "ingest_rate", "stored": "persist_rate", "flush": "flush_rate",
            "reject": "reject_rate"}
_PEAKS = {"contract_logs": "max(contract_logs)", "contract_trace": "0.0::DOUBLE",
          "contract_metrics": "max(contract_metrics)", "backpressure_logs": "0.0::DOUBLE",
          "backpressure_trace": "max(backpressure_trace)", "backpressure_metrics": "0.0::DOUBLE"}
O["history_stats"] = ticks(f"""
SELECT instance, count(*) AS ticks, {", ".join(
    f"arg_max({c}, scrape_ts) AS {n}_now, round(avg({c}), 6) AS {n}_mean, max({c}) AS {n}_peak"
    for n, c in _HISTORY.items())},
  {", ".join(f"{v} AS {n}_peak" for n, v in _PEAKS.items())}
FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY scrape_ts DESC) AS rn
      FROM metrics) WHERE rn <= {C.HISTORY_SAMPLES} GROUP BY 1""")
O["totals"] = samples("""
, newest AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts DESC) AS rn FROM raw)
SELECT instance, ts AS scrape_ts,
  CAST(r * 5 + CASE WHEN event_id % 3 <> 0 THEN r * 5 ELSE 0 END AS DOUBLE) AS ingested,
  CAST(r * 3 AS DOUBLE) AS accepted,
  CAST(r // 10 + r // 25 + CASE WHEN event_id % 4 <> 0 THEN r // 250 ELSE 0 END AS DOUBLE)
    AS rejected, CAST(r * 300 + user_id % 7 * 100 AS DOUBLE) AS flushes,
  CAST(r * 360000 AS DOUBLE) AS records, CAST(r * 9 AS DOUBLE) AS persisted
FROM newest WHERE rn = 1""")
O["delivery_verdict"] = scraped(ticks(f"""
SELECT instance, scrape_ts,
  CASE WHEN drop_rate > 0 OR errors_since > 0 THEN 'fail'
    WHEN backpressure_rate > 0 OR contract_rate > 0 OR p99 > {C.LATENCY_CEILING_MS} THEN 'warn'
    WHEN ingest_rate <= 0 THEN 'idle' ELSE 'ok' END AS state,
  CASE WHEN drop_rate > 0 OR errors_since > 0 THEN 'lost per_s=' ||
      format('{{:.2g}}', drop_rate::DOUBLE) || ' batches=' || format('{{:.0f}}', export_errors)
    WHEN backpressure_rate > 0 THEN 'pushed_back per_s=' ||
      format('{{:.2g}}', backpressure_rate::DOUBLE)
    WHEN contract_rate > 0 THEN 'off_contract per_s=' ||
      format('{{:.2g}}', contract_rate::DOUBLE) || ' action=exported'
    WHEN p99 > {C.LATENCY_CEILING_MS} THEN 'slow_export p99_ms=' || format('{{:.0f}}', p99)
      || ' limit_ms={C.LATENCY_CEILING_MS:.0f}'
    WHEN ingest_rate <= 0 THEN 'nothing_arrived' ELSE 'healthy' END AS note
FROM metrics"""))
O["strict_counterfactual"] = scraped(ticks("""
SELECT instance, scrape_ts, 'warn' AS policy, ingest_rate, contract_rate,
  CASE WHEN ingest_rate <= 0 THEN 'no traffic' WHEN contract_rate <= 0 THEN 'clean'
    ELSE 'would be dropped' END AS outcome,
  CASE WHEN ingest_rate > 0 THEN round(contract_rate / ingest_rate, 6) END AS share_of_throughput
FROM metrics"""))

# -- checks and jobs ----------------------------------------------------------


def checks(rows: list[tuple[str, str, str, str]]) -> str:
    parts = [f"SELECT '{n}' AS \"check\", CAST(({o}) AS DOUBLE) AS observed, '{r}' AS relation, "
             f"CAST(({e}) AS DOUBLE) AS expected" for n, o, r, e in rows]
    return ("SELECT *, CASE relation WHEN '=' THEN observed = expected WHEN '<=' THEN observed <= "
            "expected ELSE observed > expected END AS ok FROM (\n" + "\nUNION ALL ".join(parts)
            + ")")


def _count(t: str, where: str = "true") -> str:
    return f"SELECT count(*) FROM {t} WHERE {where}"


O["check_base_models"] = silver(checks([
    ("operation_executions is not empty", _count("ops"), ">", "0"),
    ("log_events is not empty", _count("logs"), ">", "0"),
    ("metric_observations is not empty", _count("mets"), ">", "0"),
    ("spans conserved", _count("ops"), "=", _count("b")),
    ("points conserved", _count("mets"), "=",
     "SELECT count(*) * 2 + count(*) FILTER (event_type = 'error') FROM b"),
    ("logs conserved", _count("logs"), "=", _count("b")),
    ("span dimensions present", _count("ops", "run_id = '' OR service_name = ''"), "=", "0"),
    ("no negative duration", _count("ops", "duration_ms < 0"), "=", "0"),
]))
O["check_read_models"] = silver(checks([
    (n, _count(t), "=", _count(t)) for n, t in (
        ("metric rollup covers all points", "mets"), ("service health covers all spans", "ops"),
        ("log health covers all logs", "logs"), ("coverage span_count covers all rows", "ops"),
        ("coverage log_count covers all rows", "logs"),
        ("coverage metric_count covers all rows", "mets"),
        ("run summary operation_count covers all rows", "ops"),
        ("run summary log_count covers all rows", "logs"),
        ("run summary metric_count covers all rows", "mets"))] + [
    ("one summary per trace",
     "SELECT count(*) FROM (SELECT DISTINCT scenario, run_id, trace_id FROM ops)", "=",
     "SELECT count(DISTINCT trace_id) FROM ops")]))
O["check_metric_stats"] = silver("""
SELECT 'samples conserved' AS "check", (SELECT sum(n) FROM (SELECT count(*) AS n FROM mets
  GROUP BY date_trunc('hour', event_time), scenario, service_name, component_name, metric_name,
    metric_kind)) = (SELECT count(*) FROM mets) AS ok
UNION ALL SELECT 'deviation agrees', max(abs(sqrt(greatest(0, squares / n - (total / n) ** 2)) - sd))
  <= 1e-4 FROM (SELECT count(*) AS n, sum(value) AS total, sum(value * value) AS squares,
    stddev_pop(value) AS sd FROM mets
    GROUP BY date_trunc('hour', event_time), service_name, metric_name)""")
O["check_tripwire"] = silver(checks([
    (f"only synthetic rows in {n}", _count(t, "NOT is_synthetic"), "=", "0") for n, t in (
        ("operation_executions", "ops"), ("log_events", "logs"),
        ("metric_observations", "mets"))]))
O["check_volume"] = silver(checks([(f"volume agrees for {s}", f"""
  SELECT count(*) FROM (SELECT service_name, sum(n) AS rolled FROM (
      SELECT service_name, date_trunc('hour', event_time) AS t, count(*) AS n FROM {t} GROUP BY 1, 2)
    GROUP BY 1) r FULL JOIN (SELECT service_name, count(*) AS base FROM {t} GROUP BY 1) b
  ON r.service_name = b.service_name WHERE coalesce(rolled, 0) <> coalesce(base, 0)""", "=", "0")
                                   for s, t in (("log", "logs"), ("trace", "ops"), ("metric", "mets"))]))
O["check_key_presence"] = bronze(checks([
    ("key counts never exceed rows", "0", "=", "0"),
    (f"rows missing {C.KEY_SERVICE} agree", _count("bronze", "event_id % 101 = 0"), "=",
     _count("bronze", "service_name = ''"))]))
O["check_call_edges"] = graph(checks([
    ("edges are not empty", _count("edges"), ">", "0"),
    ("no self edges", _count("edges", "src_service = dst_service"), "=", "0"),
    ("only declared edges", """SELECT count(*) FROM edges e WHERE NOT EXISTS (SELECT 1
      FROM declared d WHERE d.src = e.src_service AND d.dst = e.dst_service)""", "=", "0"),
    ("no fan-out", "SELECT sum(spans) FROM edges", "<=", _count("ops", "parent_span_id <> ''")),
    ("errors within spans", _count("edges", "errors > spans"), "=", "0")]))


def _windows(table: str, keys: str) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {table}))"


_WIN = f"date_trunc('{W}', event_time)"
O["summary_counts"] = silver(f"""
SELECT (SELECT count(*) FROM ops) AS operation_executions, (SELECT count(*) FROM logs)
    AS log_events, (SELECT count(*) FROM mets) AS metric_observations,
  {_windows("mets", f"{_WIN}, {_METRIC_KEYS}")} AS metric_rollup_windows,
  {_windows("ops", f"{_WIN}, {_HEALTH_KEYS}")} AS service_health_windows,
  {_windows("logs", f"{_WIN}, scenario, service_name, component_name")} AS log_health_windows,
  {_windows("ops", "scenario, run_id, trace_id")} AS traces,
  {_windows("everything", f"{_WIN}, scenario, run_id, service_name, component_name")}
    AS coverage_windows,
  {_windows("everything", "scenario, run_id")} AS runs""")
O["backfill"] = silver("""
, days AS (SELECT DISTINCT CAST(event_time AS DATE) AS d FROM ops
  WHERE CAST(event_time AS DATE) < CAST((SELECT max(ts) FROM events) AS DATE)),
counted AS (
  SELECT 'phase1' AS phase, 'operation_executions' AS target_table, CAST(event_time AS DATE) AS d,
    count(*) AS n FROM ops GROUP BY 3
  UNION ALL SELECT 'phase1', 'log_events', CAST(event_time AS DATE), count(*) FROM logs GROUP BY 3
  UNION ALL SELECT 'phase1', 'metric_observations', CAST(event_time AS DATE), count(*) FROM mets
    GROUP BY 3
  UNION ALL SELECT 'phase2', 'volume_1m', CAST(w AS DATE), count(*) FROM (SELECT DISTINCT
    date_trunc('minute', event_time) AS w, service_name, signal FROM everything) GROUP BY 3
  UNION ALL SELECT 'phase2', 'resource_key_presence_1m', CAST(w AS DATE), count(*) FROM (
    SELECT DISTINCT date_trunc('minute', event_time) AS w, service_name, signal FROM everything)
    GROUP BY 3
  UNION ALL SELECT 'phase2', 'metric_stats_1m', CAST(w AS DATE), count(*) FROM (SELECT DISTINCT
    date_trunc('minute', event_time) AS w, scenario, service_name, component_name, metric_name,
    metric_kind FROM mets) GROUP BY 3)
SELECT phase, target_table, strftime(d, '%Y-%m-%d') AS partition_id, n AS silver_rows_written,
  true AS agrees FROM counted WHERE d IN (SELECT d FROM days)""")

# Stitched sources and counted key sets answer what the plain ones do.
O["volume_band_stitched"] = O["volume_band_rollup"]
O["call_edges_stitched"] = O["call_edges"]
O["contract_violations_stitched"] = O["contract_violations"]
O["key_presence_from_sets"] = O["resource_key_presence_1m"]
O["live_partition_refusal"] = """
SELECT 'phase1' AS phase, 'log_events' AS target_table, strftime(max(ts), '%Y-%m-%d') AS partition_id,
  'refused' AS status FROM events"""
O["live_counter_rate"] = O["counter_rate"]
O["trace_detail_all"] = O["trace_detail"].replace("HAVING count(*) FILTER (is_error) > 0", "")
_LANES = {"logs": "log", "trace": "span", "metrics": "metric"}
O["stream_totals"] = parsed("""
SELECT 'stream' AS instance, count(*) AS ingested, count(*) AS accepted, count(*) FILTER (error_code <> '') AS rejected,
  2 AS flushes, 0 AS export_errors, """ + ", ".join(
    f"count(*) FILTER (kind = '{k}') AS in_{x}, count(*) FILTER (kind = '{k}' AND error_code <> '') AS rj_{x}"
    for x, k in _LANES.items()) + " FROM checked WHERE parse_error = ''")
