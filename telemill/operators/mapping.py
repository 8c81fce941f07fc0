"""Accepted signals -> bronze rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill import contract as C
from telemill.functions.columns import attr, ns_to_timestamp, sorted_map


def _resource() -> Column:
    """Full resource map with the contract version folded in, in key order."""
    merged = F.map_concat(
        F.col("resource_attributes"),
        F.create_map(F.lit(C.KEY_CONTRACT_VERSION), F.col("contract_version")))
    return sorted_map(merged).alias("ResourceAttributes")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def time_columns(ns: str, prefix: str) -> list[Column]:
    ts = ns_to_timestamp(ns)
    return [ts.alias(prefix), F.col(ns).alias(f"{prefix}Ns"), F.to_date(ts).alias(f"{prefix}Date")]


def to_bronze_log(signals: DataFrame) -> DataFrame:
    number = F.col("severity_number")
    rows = signals.select(
        *time_columns("time_unix_nano", "Timestamp"),
        F.date_trunc("second", ns_to_timestamp("time_unix_nano")).alias("TimestampTime"),
        _text("trace_id").alias("TraceId"), _text("span_id").alias("SpanId"),
        F.col("severity_text").alias("SeverityText"),
        F.when(number.between(0, 255), number).otherwise(0).cast("smallint")
        .alias("SeverityNumber"),
        attr("resource_attributes", C.KEY_SERVICE).alias("ServiceName"),
        F.col("body").alias("Body"), _resource(), sorted_map("attributes").alias("LogAttributes"))
    return rows


def to_bronze_span(signals: DataFrame) -> DataFrame:
    return signals.select(
        *time_columns("start_unix_nano", "Timestamp"),
        F.col("trace_id").alias("TraceId"), F.col("span_id").alias("SpanId"),
        _text("parent_span_id").alias("ParentSpanId"), F.col("name").alias("SpanName"),
        attr("resource_attributes", C.KEY_SERVICE).alias("ServiceName"),
        (F.col("end_unix_nano") - F.col("start_unix_nano")).alias("Duration"),
        F.when(F.col("status_code") == "ERROR", F.lit("Error")).otherwise(F.lit("Ok"))
        .alias("StatusCode"),
        _resource(), sorted_map("attributes").alias("SpanAttributes"))


def to_bronze_metric(signals: DataFrame) -> DataFrame:
    return signals.select(
        *time_columns("time_unix_nano", "TimeUnix"),
        F.timestamp_micros(F.lit(0)).alias("StartTimeUnix"),
        attr("resource_attributes", C.KEY_SERVICE).alias("ServiceName"),
        F.col("name").alias("MetricName"), F.lit("").alias("MetricUnit"),
        F.col("value").alias("Value"), _resource(), sorted_map("attributes").alias("Attributes"))


def route_metric(signals: DataFrame, kind: str) -> DataFrame:
    """The data-point type alone decides the metric table."""
    return signals.filter((F.col("signal_type") == "metric") & (F.col("type") == kind))


def to_bronze(signals: DataFrame) -> dict[str, DataFrame]:
    """A mixed set of signals, split over the four destination tables."""
    return {
        "otel_logs": to_bronze_log(signals.filter(F.col("signal_type") == "log")),
        "otel_traces": to_bronze_span(signals.filter(F.col("signal_type") == "span")),
        "otel_metrics_gauge": to_bronze_metric(route_metric(signals, "gauge")),
        "otel_metrics_sum": to_bronze_metric(route_metric(signals, "sum")),
    }


def derive_log_time_columns(logs: DataFrame) -> DataFrame:
    """Date and second of a log, from its timestamp."""
    return logs.withColumn("TimestampDate", F.to_date("Timestamp")).withColumn(
        "TimestampTime", F.date_trunc("second", F.col("Timestamp")))
