"""Read views over the silver models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill.functions.columns import bucket, sorted_set
from telemill.functions.quantiles import exact_quantiles

HEALTH_KEYS = ["window_start", "scenario", "service_name", "component_name", "operation_name"]


def trace_id_ts(traces: DataFrame) -> DataFrame:
    """First and last timestamp of every trace: the look-up that bounds a trace query."""
    return traces.filter(F.col("TraceId") != "").groupBy("TraceId").agg(
        F.min("Timestamp").alias("Start"), F.max("Timestamp").alias("End"))


def trace_id_ts_partials(traces: DataFrame) -> DataFrame:
    """The same per date, as one batch adds it to the stored look-up."""
    return traces.filter(F.col("TraceId") != "").groupBy(
        "TraceId", F.col("TimestampDate").alias("event_date")).agg(
        F.min("Timestamp").alias("Start"), F.max("Timestamp").alias("End")).select(
        "TraceId", "Start", "End", "event_date")


def merge_trace_id_partials(partials: DataFrame) -> DataFrame:
    """Pieces folded, still per date: what a compaction stores."""
    return partials.groupBy("TraceId", "event_date").agg(
        F.min("Start").alias("Start"), F.max("End").alias("End")).select(
        "TraceId", "Start", "End", "event_date")


def merge_trace_id_ts(partials: DataFrame) -> DataFrame:
    """The look-up as readers see it: all pieces and dates merged per trace."""
    return partials.groupBy("TraceId").agg(F.min("Start").alias("Start"),
                                           F.max("End").alias("End"))


def service_health_1m(operations: DataFrame, width: str = "minute",
                      keys: list[str] | None = None) -> DataFrame:
    """Counts, error rate and exact latency quantiles per operation and bucket.

    Ranking runs on the integer nanoseconds; the result is in milliseconds.
    """
    keys = keys or HEALTH_KEYS
    ranked = exact_quantiles(
        operations.withColumn("window_start", bucket("event_time", width)),
        keys, "duration_ns",
        {"p50": (50, 100), "p95": (95, 100), "p99": (99, 100)},
        count="operation_count", maximum="hi", flags={"error_count": F.col("is_error")})
    ms = [(F.col(c) / 1000000.0).alias(f"latency_{c}_ms") for c in ("p50", "p95", "p99")]
    return ranked.select(
        *keys, "operation_count", "error_count",
        (F.col("error_count") / F.col("operation_count")).alias("error_rate"),
        *ms, (F.col("hi") / 1000000.0).alias("latency_max_ms"))


def log_health_1m(logs: DataFrame, width: str = "minute") -> DataFrame:
    """The empty trace id counts as one value, so the distinct count is over all rows."""
    return (
        logs.withColumn("window_start", bucket("event_time", width))
        .groupBy("window_start", "scenario", "service_name", "component_name")
        .agg(F.count("*").alias("log_count"), F.count_if("is_error").alias("error_log_count"),
             F.max("severity_number").alias("max_severity_number"),
             F.count_distinct("trace_id").alias("affected_trace_count"))
        .withColumn("error_log_rate", F.col("error_log_count") / F.col("log_count")))


def trace_summary(operations: DataFrame) -> DataFrame:
    """One row per trace.  Ties on time are broken by service name."""
    return (
        operations.filter(F.col("trace_id") != "")
        .groupBy("scenario", "run_id", "trace_id")
        .agg(F.min("event_time").alias("trace_start"), F.max("end_time").alias("trace_end"),
             F.count("*").alias("span_count"), F.count_if("is_error").alias("error_span_count"),
             F.min_by("service_name", F.struct("event_time_ns", "service_name"))
             .alias("entry_service"),
             F.max_by("service_name", F.struct("end_time_ns", "service_name"))
             .alias("exit_service"),
             sorted_set("service_name").alias("services"),
             sorted_set("component_name").alias("components"))
        .withColumn("trace_duration_ms",
                    (F.unix_micros("trace_end") - F.unix_micros("trace_start")) / 1000.0)
        .withColumn("has_error", F.col("error_span_count") > 0))


def telemetry_coverage_1m(silver: dict[str, DataFrame], width: str = "minute") -> DataFrame:
    """What each component sent, by kind, and how many metric names it used."""
    keys = ["window_start", "scenario", "run_id", "service_name", "component_name"]

    def part(table: str, signal: str):
        name = F.col("metric_name") if table == "metric_observations" else F.lit("")
        return silver[table].select(
            bucket("event_time", width).alias("window_start"), *keys[1:],
            name.alias("metric_name"), F.lit(signal).alias("signal"))

    rows = (part("operation_executions", "span").unionByName(part("log_events", "log"))
            .unionByName(part("metric_observations", "metric")))

    def of(signal: str):
        return F.count_if(F.col("signal") == signal)

    return rows.groupBy(*keys).agg(
        of("span").alias("span_count"), of("log").alias("log_count"),
        of("metric").alias("metric_count"),
        F.count_distinct(F.when(F.col("metric_name") != "", F.col("metric_name")))
        .alias("metric_name_count"))


def run_summary(silver: dict[str, DataFrame]) -> DataFrame:
    """One row per run.

    Two light shapes instead of one aggregate with two distinct counts (which would multiply
    every row): counters collapse to (run, service) before the shuffle, and distinct traces
    shuffle three narrow columns of spans and logs only.
    """
    run = ["scenario", "run_id"]
    spans, logs, metrics = (silver[t] for t in
                            ("operation_executions", "log_events", "metric_observations"))

    def part(df, signal, failed):
        return df.select(*run, "service_name", "event_time", F.lit(signal).alias("signal"),
                         failed.alias("failed"))

    rows = (part(spans, "span", F.col("is_error")).unionByName(part(logs, "log", F.col("is_error")))
            .unionByName(part(metrics, "metric", F.lit(False))))
    kind = F.col("signal")
    counters = {
        "operation_count": kind == "span",
        "operation_error_count": (kind == "span") & F.col("failed"),
        "log_count": kind == "log",
        "log_error_count": (kind == "log") & F.col("failed"),
        "metric_count": kind == "metric",
    }
    per_service = rows.groupBy(*run, "service_name").agg(
        F.min("event_time").alias("run_start"), F.max("event_time").alias("run_end"),
        *[F.count_if(c).alias(n) for n, c in counters.items()])
    totals = per_service.groupBy(*run).agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
        F.count("*").alias("service_count"), *[F.sum(n).alias(n) for n in counters])
    traces = (
        spans.select(*run, "trace_id").unionByName(logs.select(*run, "trace_id"))
        .filter(F.col("trace_id") != "").distinct()
        .groupBy(*run).agg(F.count("*").alias("trace_count")))
    return totals.join(traces, run, "left").select(
        *run, "run_start", "run_end",
        (F.unix_millis("run_end") - F.unix_millis("run_start")).alias("observed_duration_ms"),
        "service_count", F.coalesce("trace_count", F.lit(0)).alias("trace_count"), *counters)


def service_health(health: DataFrame, since=None, limit: int | None = 12) -> DataFrame:
    """Board figures per producer over the minutes since ``since``.

    The p50 is the mean of the minute medians, the tails are the worst minute: this is how
    the board defines them.
    """
    rows = health
    if since is not None:
        rows = rows.filter(F.col("window_start") >= F.lit(since))
        if "event_date" in rows.columns:
            rows = rows.filter(F.col("event_date") >= F.to_date(F.lit(since)))
    out = rows.groupBy("service_name").agg(
        F.sum("operation_count").alias("ops"), F.sum("error_count").alias("errors"),
        F.round(F.avg("latency_p50_ms"), 1).alias("p50"),
        F.round(F.max("latency_p95_ms"), 1).alias("p95"),
        F.round(F.max("latency_p99_ms"), 1).alias("p99"),
        F.round(F.max("latency_max_ms"), 1).alias("worst"))
    out = out.withColumn("error_rate", F.round(F.col("errors") / F.col("ops"), 5))
    return out if limit is None else out.orderBy(F.desc("ops"), "service_name").limit(limit)


def metric_rollup_views(silver: dict[str, DataFrame], partials: DataFrame | None,
                        width: str = "minute") -> DataFrame:
    """Merged view when partials are complete, direct view until then."""
    from telemill.plans import rollups

    if partials is not None:
        return rollups.metric_rollup_merged(partials)
    return rollups.metric_rollup_direct(silver["metric_observations"], width)
