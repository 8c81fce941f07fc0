"""Bronze -> typed silver models.  Stateless projections, valid on batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill import contract as C
from telemill.functions.columns import attr, is_error_log, is_true, ns_to_timestamp


def _dimensions() -> list[Column]:
    r = "ResourceAttributes"
    return [
        attr(r, C.KEY_SCENARIO).alias("scenario"),
        attr(r, C.KEY_RUN_ID).alias("run_id"),
        attr(r, C.KEY_PROVIDER).alias("cloud_provider"),
        is_true(r, C.KEY_SYNTHETIC).alias("is_synthetic"),
        attr(r, C.KEY_CONTRACT_VERSION).alias("contract_version"),
        F.col("ServiceName").alias("service_name"),
    ]


def operation_executions(traces: DataFrame) -> DataFrame:
    end_ns = F.col("TimestampNs") + F.col("Duration")
    return traces.select(
        F.col("Timestamp").alias("event_time"), F.col("TimestampNs").alias("event_time_ns"),
        ns_to_timestamp(end_ns).alias("end_time"), end_ns.alias("end_time_ns"),
        *_dimensions(),
        attr("SpanAttributes", C.KEY_COMPONENT_NAME).alias("component_name"),
        attr("SpanAttributes", C.KEY_COMPONENT_TYPE).alias("component_type"),
        F.col("SpanName").alias("operation_name"),
        F.col("TraceId").alias("trace_id"), F.col("SpanId").alias("span_id"),
        F.col("ParentSpanId").alias("parent_span_id"),
        F.col("Duration").alias("duration_ns"),
        (F.col("Duration") / 1000000.0).alias("duration_ms"),
        F.col("StatusCode").alias("status_code"),
        (F.col("StatusCode") == "Error").alias("is_error"),
        F.col("ResourceAttributes").alias("resource_attributes"),
        F.col("SpanAttributes").alias("operation_attributes"),
        F.col("TimestampDate").alias("event_date"),
    )


def log_events(logs: DataFrame) -> DataFrame:
    return logs.select(
        F.col("Timestamp").alias("event_time"), F.col("TimestampNs").alias("event_time_ns"),
        *_dimensions(),
        attr("LogAttributes", C.KEY_COMPONENT_NAME).alias("component_name"),
        F.col("SeverityText").alias("severity_text"),
        F.col("SeverityNumber").alias("severity_number"),
        is_error_log("SeverityNumber", "SeverityText").alias("is_error"),
        F.col("Body").alias("body"), F.col("TraceId").alias("trace_id"),
        F.col("SpanId").alias("span_id"),
        F.col("ResourceAttributes").alias("resource_attributes"),
        F.col("LogAttributes").alias("log_attributes"),
        F.col("TimestampDate").alias("event_date"),
    )


def _observations(points: DataFrame, kind: str) -> DataFrame:
    unit = F.when(F.col("MetricUnit") != "", F.col("MetricUnit")).otherwise(
        attr("Attributes", "unit"))
    return points.select(
        F.col("TimeUnix").alias("event_time"), F.col("TimeUnixNs").alias("event_time_ns"),
        F.col("StartTimeUnix").alias("start_time"),
        *_dimensions(),
        attr("Attributes", C.KEY_COMPONENT_NAME).alias("component_name"),
        attr("Attributes", C.KEY_COMPONENT_TYPE).alias("component_type"),
        F.col("MetricName").alias("metric_name"), F.lit(kind).alias("metric_kind"),
        unit.alias("metric_unit"), F.col("Value").alias("value"),
        attr("Attributes", "status").alias("status"),
        F.col("ResourceAttributes").alias("resource_attributes"),
        F.col("Attributes").alias("metric_attributes"),
        F.col("TimeUnixDate").alias("event_date"),
    )


def metric_observations(gauge: DataFrame, sums: DataFrame) -> DataFrame:
    return _observations(gauge, "gauge").unionByName(_observations(sums, "sum"))


def to_silver(bronze: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "operation_executions": operation_executions(bronze["otel_traces"]),
        "log_events": log_events(bronze["otel_logs"]),
        "metric_observations": metric_observations(bronze["otel_metrics_gauge"],
                                                   bronze["otel_metrics_sum"]),
    }
