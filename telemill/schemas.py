"""Explicit schemas.  Nothing in the library infers one."""

def ddl(spec: str) -> str:
    return ", ".join(
        f"{name} {'map<string,string>' if kind == 'attrs' else kind}"
        for name, kind in (item.split() for item in spec.split(","))
    )


# One wide record for all three signal kinds, as it arrives (one JSON object per line).
# Everything is nullable: a missing required field is a parse error, found later.
SIGNAL_DDL = ddl(
    "signal_type string, contract_version string, time_unix_nano bigint, start_unix_nano bigint,"
    "end_unix_nano bigint, severity_text string, severity_number int, service_name string,"
    "body string, trace_id string, span_id string, parent_span_id string, name string,"
    "status_code string, type string, value double, attributes attrs, resource_attributes attrs"
)

BRONZE_LOGS_DDL = ddl(
    "Timestamp timestamp, TimestampNs bigint, TimestampDate date, TimestampTime timestamp,"
    "TraceId string, SpanId string, SeverityText string, SeverityNumber smallint,"
    "ServiceName string, Body string, ResourceAttributes attrs, LogAttributes attrs"
)
BRONZE_TRACES_DDL = ddl(
    "Timestamp timestamp, TimestampNs bigint, TimestampDate date, TraceId string, SpanId string,"
    "ParentSpanId string, SpanName string, ServiceName string, Duration bigint,"
    "StatusCode string, ResourceAttributes attrs, SpanAttributes attrs"
)
BRONZE_METRICS_DDL = ddl(
    "TimeUnix timestamp, TimeUnixNs bigint, TimeUnixDate date, StartTimeUnix timestamp,"
    "ServiceName string, MetricName string, MetricUnit string, Value double,"
    "ResourceAttributes attrs, Attributes attrs"
)
BRONZE_DDL = {
    "otel_logs": BRONZE_LOGS_DDL,
    "otel_traces": BRONZE_TRACES_DDL,
    "otel_metrics_gauge": BRONZE_METRICS_DDL,
    "otel_metrics_sum": BRONZE_METRICS_DDL,
}
BRONZE_DATE = {"otel_logs": "TimestampDate", "otel_traces": "TimestampDate",
               "otel_metrics_gauge": "TimeUnixDate", "otel_metrics_sum": "TimeUnixDate"}

SILVER_DDL = {
    "operation_executions": ddl(
        "event_time timestamp, event_time_ns bigint, end_time timestamp, end_time_ns bigint,"
        "scenario string, run_id string, cloud_provider string, is_synthetic boolean,"
        "contract_version string, service_name string, component_name string,"
        "component_type string, operation_name string, trace_id string, span_id string,"
        "parent_span_id string, duration_ns bigint, duration_ms double, status_code string,"
        "is_error boolean, resource_attributes attrs, operation_attributes attrs, event_date date"),
    "log_events": ddl(
        "event_time timestamp, event_time_ns bigint, scenario string, run_id string,"
        "cloud_provider string, is_synthetic boolean, contract_version string,"
        "service_name string, component_name string, severity_text string,"
        "severity_number smallint, is_error boolean, body string, trace_id string,"
        "span_id string, resource_attributes attrs, log_attributes attrs, event_date date"),
    "metric_observations": ddl(
        "event_time timestamp, event_time_ns bigint, start_time timestamp, scenario string,"
        "run_id string, cloud_provider string, is_synthetic boolean, contract_version string,"
        "service_name string, component_name string, component_type string, metric_name string,"
        "metric_kind string, metric_unit string, value double, status string,"
        "resource_attributes attrs, metric_attributes attrs, event_date date"),
}
ROLLUP_DDL = {
    "metric_stats_1m": (
        "window_start timestamp, scenario string, service_name string, component_name string,"
        "metric_name string, metric_kind string, sample_count bigint, sum_value double,"
        "sum_squares double, min_value double, max_value double, event_date date"),
    "volume_1m": (
        "window_start timestamp, service_name string, signal string, rows bigint, event_date date"),
    "resource_key_presence_1m": (
        "window_start timestamp, service_name string, signal string, rows bigint,"
        "key_counts map<string,bigint>, event_date date"),
}
# Partials of the read models: counts by latency slot, log counters, the traces of logs, what components sent.
PARTIAL_DDL = {
    "latency_slots_1m": (
        "window_start timestamp, scenario string, service_name string, component_name string,"
        "operation_name string, slot bigint, operations bigint, errors bigint, highest_ns bigint, event_date date"),
    "log_counts_1m": (
        "window_start timestamp, scenario string, service_name string, component_name string,"
        "log_count bigint, error_log_count bigint, max_severity_number int, traces_sketch binary, event_date date"),
    "log_traces_1m": (
        "window_start timestamp, scenario string, service_name string, component_name string,"
        "trace_id string, event_date date"),
    "key_sets_1m": (
        "window_start timestamp, service_name string, signal string, keys array<string>, rows bigint, event_date date"),
    "coverage_parts_1m": (
        "window_start timestamp, scenario string, run_id string, service_name string, component_name string,"
        "span_count bigint, log_count bigint, metric_count bigint, metric_names array<string>, event_date date"),
}
LOOKUP_DDL = {
    "trace_id_ts": "TraceId string, Start timestamp, End timestamp, event_date date"}
# What each batch of a stream did, beside who ran it and when it ended: deltas, so that a replayed batch replaces its row.
TICK_DDL = {
    "stream_ticks": (
        "instance string, scrape_ts timestamp, batch bigint, logs bigint, trace bigint, metrics bigint, unread bigint,"
        "rejected_logs bigint, rejected_trace bigint, rejected_metrics bigint, persisted bigint, failed bigint,"
        "seconds double, event_date date"),
}
EDGE_DDL = ("window_start timestamp, src_service string, dst_service string, spans bigint,"
            "errors bigint, event_date date")
LEDGER_DDL = (
    "run_id string, phase string, target_table string, partition_id string,"
    "bronze_rows_before bigint, bronze_rows_after bigint, silver_rows_written bigint,"
    "content_hash decimal(38,0), expected_hash decimal(38,0), started_at timestamp,"
    "finished_at timestamp, status string")

# Checksums of stored pieces; ``version`` counts the marks of rewrites a piece had when it was read.
SUMS_DDL = "piece string, rows bigint, content_hash decimal(38,0), version int, day string"

# OTLP/JSON.  64-bit integers travel as strings in that encoding and as numbers from
# some senders; both read as string here and are cast.
_VALUE = ("struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,"
          "bytesValue:string,arrayValue:string,kvlistValue:string>")
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRS}>"
_POINT = (f"struct<timeUnixNano:string,asDouble:double,asInt:string,attributes:{_ATTRS}>")
OTLP_TRACES_DDL = (
    f"resourceSpans array<struct<{_RESOURCE},scopeSpans:array<struct<spans:array<struct<"
    "traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,status:struct<code:string>,attributes:{_ATTRS}>>>>>>")
OTLP_LOGS_DDL = (
    f"resourceLogs array<struct<{_RESOURCE},scopeLogs:array<struct<logRecords:array<struct<"
    "timeUnixNano:string,severityNumber:string,severityText:string,"
    f"body:{_VALUE},traceId:string,spanId:string,attributes:{_ATTRS}>>>>>>")
OTLP_METRICS_DDL = (
    f"resourceMetrics array<struct<{_RESOURCE},scopeMetrics:array<struct<metrics:array<struct<"
    f"name:string,gauge:struct<dataPoints:array<{_POINT}>>,"
    f"sum:struct<dataPoints:array<{_POINT}>>>>>>>>")

SCRAPE_LINES_DDL = "instance string, scrape_ts timestamp, line_no bigint, line string"
