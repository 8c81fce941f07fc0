"""The telemetry contract: every value that has to be equal for results to be equal."""

import os

#: What the attribute keys and metric families of the own producers begin with.  Data written
#: under other names are read by setting these two variables before the library is imported.
KEY_PREFIX = os.environ.get("TELEMILL_KEY_PREFIX", "pipeline")
FAMILY_PREFIX = os.environ.get("TELEMILL_FAMILY_PREFIX", "intake")

# ---------------------------------------------------------------------------
# Fixed values.  They are part of the wire data (attribute keys, metric family
# names, enumerations) and of the published verdict rules, so they are stated
# literally and only here; the rest of the library refers to these names.
# ---------------------------------------------------------------------------
CONTRACT_VERSION = "1.0.0"

KEY_SYNTHETIC = f"{KEY_PREFIX}.synthetic"
KEY_SCENARIO = f"{KEY_PREFIX}.scenario"
KEY_RUN_ID = f"{KEY_PREFIX}.run_id"
KEY_PROVIDER = "cloud.provider"
KEY_SERVICE = "service.name"
KEY_CONTRACT_VERSION = "contract_version"
KEY_COMPONENT_NAME = "component.name"
KEY_COMPONENT_TYPE = "component.type"

REQUIRED_RESOURCE_KEYS = (KEY_SYNTHETIC, KEY_SCENARIO, KEY_RUN_ID, KEY_PROVIDER, KEY_SERVICE)

UNKNOWN_SERVICE = "unknown_service"
ERROR_SEVERITY_NUMBER = 17
ERROR_SEVERITY_TEXTS = ("ERROR", "FATAL")

METRIC_INGESTED = f"{FAMILY_PREFIX}_signals_ingested_total"
METRIC_ACCEPTED = f"{FAMILY_PREFIX}_signals_accepted_total"
METRIC_REJECTED = f"{FAMILY_PREFIX}_signals_rejected_total"
METRIC_STORAGE = f"{FAMILY_PREFIX}_storage_signals_total"
METRIC_FLUSH_COUNT = f"{FAMILY_PREFIX}_batch_flush_size_count"
METRIC_FLUSH_SUM = f"{FAMILY_PREFIX}_batch_flush_size_sum"
METRIC_EXPORT_ERRORS = f"{FAMILY_PREFIX}_export_errors_total"
METRIC_LATENCY = f"{FAMILY_PREFIX}_export_latency_seconds"

SIGNAL_LANES = ("logs", "trace", "metrics")
REJECT_REASONS = ("contract", "backpressure")

# Delivery mode and verdict thresholds.
BATCH_FLUSH_RATE = 3.0
BATCH_RECORDS_PER_FLUSH = 1500.0
FLUSH_RATE_SAMPLES = 5
HISTORY_SAMPLES = 120
LATENCY_CEILING_MS = 80.0

# Volume band.
Z_WARN = 3.0
Z_ERROR = 5.0
MAD_TO_SIGMA = 1.4826
MIN_BUCKETS = 8
MAX_OOB_SHARE = 0.15

# Silence and edge health.
ABSENT_SHARE = 0.1
ABSENT_MIN = 2
EDGE_WARN_RATE = 0.01
EDGE_FAIL_RATE = 0.05

# Retention in days of event time.
RETENTION_DAYS = 30
EDGE_RETENTION_DAYS = 2
EDGE_WINDOW_MINUTES = 24 * 60
COVERAGE_READINGS = 7

# Canonical field -> stored column, per signal kind.
COLUMN_MAP = {
    "log": {
        "time_unix_nano": "Timestamp", "service_name": "ServiceName",
        "severity_text": "SeverityText", "severity_number": "SeverityNumber", "body": "Body",
        "trace_id": "TraceId", "span_id": "SpanId", "attributes": "LogAttributes",
        "resource_attributes": "ResourceAttributes",
    },
    "span": {
        "start_unix_nano": "Timestamp", "trace_id": "TraceId", "span_id": "SpanId",
        "parent_span_id": "ParentSpanId", "name": "SpanName", "service_name": "ServiceName",
        "duration_nano": "Duration", "status_code": "StatusCode", "attributes": "SpanAttributes",
        "resource_attributes": "ResourceAttributes",
    },
    "metric": {
        "time_unix_nano": "TimeUnix", "name": "MetricName", "type": "MetricType", "value": "Value",
        "service_name": "ServiceName", "attributes": "Attributes",
        "resource_attributes": "ResourceAttributes",
    },
}
# ---------------------------------------------------------------------------

BRONZE_TABLES = ("otel_logs", "otel_traces", "otel_metrics_gauge", "otel_metrics_sum")
# Declared by the model, empty in this contract version.
BRONZE_EMPTY_TABLES = ("otel_metrics_histogram", "otel_metrics_exponential_histogram",
                       "otel_metrics_summary")
SILVER_TABLES = ("operation_executions", "log_events", "metric_observations")
ROLLUP_TABLES = ("metric_stats_1m", "volume_1m", "resource_key_presence_1m")
EDGE_TABLE = "call_edges_1m"
POLICIES = ("off", "warn", "strict")
