"""Explorer queries: filter, project, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill.functions.columns import attr, bucket


def _between(df: DataFrame, ts: str, since, until, date: str = "TimestampDate") -> DataFrame:
    """A time range, and the date range around it, which prunes partitions."""
    if since is not None:
        df = df.filter((F.col(ts) >= F.lit(since)) & (F.col(date) >= F.to_date(F.lit(since))))
    if until is not None:
        df = df.filter((F.col(ts) < F.lit(until)) & (F.col(date) <= F.to_date(F.lit(until))))
    return df


def log_search(logs: DataFrame, *, text: str | None = None, pattern: str | None = None,
               service: str | None = None, severity: str | None = None,
               attributes: dict[str, str] | None = None, since=None, until=None,
               limit: int | None = None) -> DataFrame:
    """Filter logs by time, producer, severity, body text or pattern, and attributes."""
    rows = _between(logs, "Timestamp", since, until)
    if service is not None:
        rows = rows.filter(F.col("ServiceName") == service)
    if severity is not None:
        rows = rows.filter(F.col("SeverityText") == severity)
    if text is not None:
        rows = rows.filter(F.col("Body").contains(text))
    if pattern is not None:
        rows = rows.filter(F.col("Body").rlike(pattern))
    for key, value in (attributes or {}).items():
        rows = rows.filter((attr("LogAttributes", key) == value)
                           | (attr("ResourceAttributes", key) == value))
    rows = rows.select("Timestamp", "ServiceName", "SeverityText", "Body")
    return rows if limit is None else rows.orderBy(F.desc("Timestamp"), "ServiceName",
                                                   "Body").limit(limit)


def trace_search(traces: DataFrame, *, service: str | None = None, status: str | None = None,
                 name: str | None = None, since=None, until=None,
                 limit: int | None = None) -> DataFrame:
    rows = _between(traces, "Timestamp", since, until)
    for column, wanted in (("ServiceName", service), ("StatusCode", status), ("SpanName", name)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    rows = rows.select("Timestamp", "ServiceName", "StatusCode",
                       F.round(F.col("Duration") / 1e6).alias("duration_ms"), "SpanName")
    return rows if limit is None else rows.orderBy(F.desc("Timestamp"), "ServiceName",
                                                   "SpanName").limit(limit)


def metric_series(gauge: DataFrame, sums: DataFrame, metric: str | None = None,
                  width: str = "minute", since=None, until=None) -> DataFrame:
    """Points of a metric over time, by bucket and producer; all metrics when unnamed."""
    def part(points: DataFrame, kind: str) -> DataFrame:
        points = _between(points, "TimeUnix", since, until, "TimeUnixDate")
        return points.select(F.lit(kind).alias("metric_kind"), "MetricName", "ServiceName",
                             bucket("TimeUnix", width).alias("window_start"), "Value")

    rows = part(gauge, "gauge").unionByName(part(sums, "sum"))
    if metric is not None:
        rows = rows.filter(F.col("MetricName") == metric)
    return rows.groupBy("metric_kind", "MetricName", "ServiceName", "window_start").agg(
        F.count("*").alias("points"), F.avg("Value").alias("avg_value"),
        F.min("Value").alias("min_value"), F.max("Value").alias("max_value"))


def error_logs(log_events: DataFrame, limit: int | None = None) -> DataFrame:
    rows = log_events.filter("is_error").select(
        "event_time", "service_name", "component_name", "severity_text", "body", "trace_id")
    return rows if limit is None else rows.orderBy(F.desc("event_time"), "service_name",
                                                   "trace_id").limit(limit)


def latest_runs(run_summary: DataFrame, limit: int = 3) -> DataFrame:
    return run_summary.orderBy(F.desc("run_start"), "scenario", "run_id").limit(limit)


def latest_health(service_health: DataFrame, limit: int = 10) -> DataFrame:
    return service_health.select(
        "window_start", "service_name", "component_name", "operation_name", "scenario",
        "operation_count", "error_count", F.round("error_rate", 4).alias("error_rate"),
        F.round("latency_p95_ms", 3).alias("latency_p95_ms"),
    ).orderBy(F.desc("window_start"), "service_name", "component_name", "operation_name",
              "scenario").limit(limit)


def latest_metrics(metric_observations: DataFrame, limit: int = 5) -> DataFrame:
    return metric_observations.select(
        "event_time", "service_name", "component_name", "metric_name", "metric_kind", "value",
        "metric_unit",
    ).orderBy(F.desc("event_time"), "service_name", "metric_name").limit(limit)


def latest_traces(trace_summary: DataFrame, limit: int = 5) -> DataFrame:
    return trace_summary.orderBy(F.desc("trace_start"), "trace_id", "scenario",
                                 "run_id").limit(limit).select(
        "trace_id", "span_count", "error_span_count", "entry_service", "exit_service",
        F.round("trace_duration_ms", 3).alias("trace_duration_ms"))


def missing_dimensions(operation_executions: DataFrame) -> DataFrame:
    """Spans without one of the dimensions every span has to carry."""
    return operation_executions.filter(
        (F.col("scenario") == "") | (F.col("run_id") == "") | (F.col("service_name") == "")
        | (F.col("contract_version") == ""))


def real_data_tripwire(silver: dict[str, DataFrame]) -> DataFrame:
    """Rows per base table that are not marked synthetic."""
    out = None
    for name, df in silver.items():
        part = df.agg(F.count_if(~F.col("is_synthetic")).alias("non_synthetic")).select(
            F.lit(name).alias("table_name"), "non_synthetic")
        out = part if out is None else out.unionByName(part)
    return out
