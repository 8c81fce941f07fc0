"""Everything one trace (or a set of traces) left behind, and log-to-span correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_SHAPE = ("trace_id", "span_id", "ts_ns", "kind", "service", "label", "status")


def _span_rows(traces: DataFrame) -> DataFrame:
    return traces.select(
        F.col("TraceId").alias("trace_id"), F.col("SpanId").alias("span_id"),
        F.col("TimestampNs").alias("ts_ns"), F.lit("span").alias("kind"),
        F.col("ServiceName").alias("service"), F.col("SpanName").alias("label"),
        F.col("StatusCode").alias("status"), F.col("Timestamp").alias("ts"),
        F.col("TimestampDate").alias("event_date"))


def _log_rows(logs: DataFrame) -> DataFrame:
    return logs.select(
        F.col("TraceId").alias("trace_id"), F.col("SpanId").alias("span_id"),
        F.col("TimestampNs").alias("ts_ns"), F.lit("log").alias("kind"),
        F.col("ServiceName").alias("service"), F.col("Body").alias("label"),
        F.col("SeverityText").alias("status"), F.col("Timestamp").alias("ts"),
        F.col("TimestampDate").alias("event_date"))


def trace_detail(traces: DataFrame, logs: DataFrame, trace_id: str,
                 start=None, end=None) -> DataFrame:
    """Spans and logs of one trace in time order.

    ``start``/``end`` come from the trace look-up and prune date partitions.
    """
    rows = _span_rows(traces).unionByName(_log_rows(logs)).filter(F.col("trace_id") == trace_id)
    if start is not None:
        rows = rows.filter(F.col("event_date") >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.filter(F.col("event_date") <= F.to_date(F.lit(end)))
    return rows.select(*_SHAPE).orderBy("ts_ns", "kind", "span_id")


def trace_details(traces: DataFrame, logs: DataFrame, lookup: DataFrame) -> DataFrame:
    """The same for every trace of a look-up table (TraceId, Start, End).

    Only rows inside the span of their trace count.  The look-up is spread over the dates of each trace and joined on
    date and id: where it is small its dates prune the partitions of both tables while the query runs, so
    the files read follow the traces asked for.  A fresh key column puts a plain exchange under both
    sides of a large join, the shape in which AQE splits the partition of a hot trace.
    """
    days = F.explode(F.sequence(F.to_date("Start"), F.to_date("End")))
    wanted = lookup.filter(F.col("TraceId") != "").select("TraceId", "Start", "End", days.alias("trace_date")).select(
        F.concat(F.lit("t"), F.col("TraceId")).alias("trace_key"), "Start", "End", "trace_date")

    def found(rows: DataFrame) -> DataFrame:
        keyed = rows.filter(F.col("trace_id") != "").withColumn("trace_key", F.concat(F.lit("t"), F.col("trace_id")))
        return keyed.join(wanted, (F.col("event_date") == F.col("trace_date")) & (
            keyed["trace_key"] == wanted["trace_key"])).filter(
            F.col("ts").between(F.col("Start"), F.col("End"))).select(*_SHAPE)

    return found(_span_rows(traces)).unionByName(found(_log_rows(logs)))


def logs_with_trace(log_events: DataFrame, operations: DataFrame) -> DataFrame:
    """Each log that carries ids, beside the span it belongs to (if that span exists).

    Repeated copies of a span collapse first, so a log is never multiplied.  As in
    ``trace_details`` the join runs on a fresh key, which lets AQE split a hot span.
    """
    def key(df):
        return F.concat_ws("/", df["trace_id"], df["span_id"])

    spans = operations.filter(F.col("trace_id") != "").groupBy("trace_id", "span_id").agg(
        F.min(F.struct("operation_name", "service_name", "duration_ms", "status_code"))
        .alias("s"))
    spans = spans.select(key(spans).alias("span_key"), F.col("s.operation_name"),
                         F.col("s.service_name").alias("span_service"), F.col("s.duration_ms"),
                         F.col("s.status_code"))
    logs = log_events.filter(F.col("trace_id") != "")
    logs = logs.select(key(logs).alias("span_key"), "event_time_ns", "trace_id", "span_id",
                       "service_name", "severity_text", "body")
    return logs.join(spans, "span_key", "left").drop("span_key")
