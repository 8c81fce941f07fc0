"""One callable per operator: ``(spark, sf_dir) -> DataFrame`` over the whole input."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telemill import contract as C
from telemill.functions import checksum, verdicts as V
from telemill.functions.columns import map_text, one_value
from telemill.functions.series import running
from telemill.operators import (
    backfill as BF, edges as E, graph as G, mapping, quality as Q, search as S, silver as SV,
    traces as TR, validation as VA)
from telemill.plans import boards as B, delivery as D, partials as P, rollups as R, views as VW
from telemill.session import checkpoint_root
from telemill.sources import (
    bridge, ndjson, otlp, scrapes, sums as SM, tables as TB, topology)
from telemill.streaming import delivery, jobs, rates

WIDTH = "hour"
BAND_WIDTH = "day"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


def _round_product(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Rounded as the check SQL does: the product with 10 ** digits is.  Large numbers differ from ``_round`` in their last digits."""
    scale = float(10 ** digits)
    size = F.abs(F.col(column)) * scale
    down = F.floor(size)
    # From 2^52 on there are no fractions.  ``round`` would go through decimals, which took most of the time.
    whole = F.when(size < float(1 << 52), (down + F.when(size - down >= 0.5, 1).otherwise(0)).cast("double")).otherwise(size)
    return df.withColumn(column, F.when(F.col(column) < 0, -whole).otherwise(whole) / scale)


def _as_of(spark: SparkSession, sf: str) -> Column:
    """The newest event time, as a scalar subquery."""
    return one_value(bridge.read_events(spark, sf), F.max("ts"))


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/telemill-{uuid.uuid4().hex}"


def _count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")


def _union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


# -- sources ------------------------------------------------------------------


def _parsed(spark, sf):
    return ndjson.parse_signals(bridge.signal_lines(spark, sf))


def _validated(spark, sf):
    return VA.validate(_parsed(spark, sf))


@query
def read_signals_ndjson(spark, sf):
    ok = F.col("parse_error").isNull()
    return _parsed(spark, sf).select(
        "event_id", F.coalesce("parse_error", F.lit("")).alias("parse_error"),
        F.when(ok, F.col("signal_type")).alias("signal_type"),
        F.when(ok, F.coalesce("time_unix_nano", "start_unix_nano")).cast("string").alias("ns"),
        F.when(ok, F.col("value")).alias("value"),
        F.when(ok, map_text("attributes")).alias("attributes"),
        F.when(ok, map_text("resource_attributes")).alias("resource_attributes"))


@query
def flatten_otlp_traces(spark, sf):
    rows = otlp.flatten_otlp_traces(bridge.otlp_lines(spark, sf, "traces"))
    return rows.select("trace_id", "span_id", F.coalesce("parent_span_id", F.lit(""))
                       .alias("parent_span_id"), "name", "service_name", "start_unix_nano",
                       "end_unix_nano", "status_code", "contract_version",
                       map_text("attributes").alias("attributes"),
                       map_text("resource_attributes").alias("resource_attributes"))


@query
def flatten_otlp_logs(spark, sf):
    rows = otlp.flatten_otlp_logs(bridge.otlp_lines(spark, sf, "logs"))
    return rows.select("time_unix_nano", F.col("severity_number").cast("bigint")
                       .alias("severity_number"), "severity_text", "body", "service_name",
                       F.coalesce("trace_id", F.lit("")).alias("trace_id"),
                       F.coalesce("span_id", F.lit("")).alias("span_id"),
                       map_text("attributes").alias("attributes"))


@query
def flatten_otlp_metrics(spark, sf):
    rows = otlp.flatten_otlp_metrics(bridge.otlp_lines(spark, sf, "metrics"))
    return rows.select("time_unix_nano", "name", "type", "value", "service_name",
                       map_text("resource_attributes").alias("resource_attributes"))


@query
def skipped_otlp_metrics(spark, sf):
    return otlp.skipped_otlp_metrics(bridge.otlp_lines(spark, sf, "metrics"))


@query
def attrs_to_map(spark, sf):
    rows = otlp.flatten_otlp_traces(bridge.otlp_lines(spark, sf, "traces"))
    return rows.select(F.explode("attributes").alias("key", "text")).groupBy("key", "text").agg(
        F.count("*").alias("n"))


@query
def write_bronze(spark, sf):
    """Validated NDJSON signals written to four partitioned tables and read back."""
    root = _folder(spark)
    TB.write_bronze(VA.apply_policy(_validated(spark, sf), "warn"), root, "all")
    return _union(
        df.groupBy(F.col(TB.date_column(t)).cast("string").alias("day"), "ServiceName")
        .agg(F.count("*").alias("n")).withColumn("tbl", F.lit(t))
        for t, df in TB.read_bronze(spark, root).items())


@query
def read_scrapes(spark, sf):
    return scrapes.read_scrapes(bridge.scrape_lines(spark, sf)).drop("labels")


@query
def apply_column_map(spark, sf):
    spans = bridge.span_signals(bridge.base(bridge.read_events(spark, sf)))
    return TB.apply_column_map(spans, "span").select(
        F.col("Timestamp").alias("ts_ns"), "TraceId", "SpanId",
        F.coalesce("ParentSpanId", F.lit("")).alias("ParentSpanId"), "SpanName", "ServiceName",
        "Duration", "StatusCode", map_text("SpanAttributes").alias("SpanAttributes"))


@query
def signal_counts(spark, sf):
    return VA.signal_counts(_validated(spark, sf))


@query
def retain(spark, sf):
    as_of = _as_of(spark, sf)
    return _union(
        _count_rows(TB.retain(df, as_of, 10, TB.date_column(t)), t)
        for t, df in bridge.bronze(spark, sf).items())


# -- validation ---------------------------------------------------------------


def _codes(spark, sf, kind):
    rows = _validated(spark, sf).filter(F.col("parse_error").isNull()
                                        & (F.col("signal_type") == kind))
    return rows.select("event_id", F.coalesce("error_code", F.lit("")).alias("error_code"))


@query
def validate_log(spark, sf):
    return _codes(spark, sf, "log")


@query
def validate_span(spark, sf):
    return _codes(spark, sf, "span")


@query
def validate_metric(spark, sf):
    return _codes(spark, sf, "metric")


@query
def validate_type_domain(spark, sf):
    return _parsed(spark, sf).filter(F.col("parse_error").isNotNull()).groupBy(
        "parse_error").agg(F.count("*").alias("n"))


@query
def strict_batch_gate(spark, sf):
    """Which batches of seven lines the strict policy would refuse as a whole."""
    return VA.batch_gate(_validated(spark, sf), F.floor(F.col("event_id") / 7).cast("long"))


@query
def apply_policy(spark, sf):
    return VA.policy_counts(_validated(spark, sf))


@query
def strict_kept(spark, sf):
    return VA.apply_policy(_validated(spark, sf), "strict").select("event_id", "signal_type")


@query
def reject_matrix(spark, sf):
    return VA.reject_matrix(_validated(spark, sf))


# -- bronze and silver rows ---------------------------------------------------


@query
def to_bronze_log(spark, sf):
    return bridge.bronze(spark, sf)["otel_logs"].select(
        "Timestamp", "TimestampNs", "TimestampTime", "TraceId", "SpanId", "SeverityText",
        F.col("SeverityNumber").cast("bigint").alias("SeverityNumber"), "ServiceName", "Body",
        map_text("ResourceAttributes").alias("ResourceAttributes"),
        map_text("LogAttributes").alias("LogAttributes"))


@query
def derive_log_time_columns(spark, sf):
    logs = bridge.bronze(spark, sf)["otel_logs"].drop("TimestampDate", "TimestampTime")
    return mapping.derive_log_time_columns(logs).groupBy(
        F.col("TimestampDate").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.min("TimestampTime").alias("first_second"),
        F.max("TimestampTime").alias("last_second"))


@query
def to_bronze_span(spark, sf):
    return bridge.bronze(spark, sf)["otel_traces"].select(
        "Timestamp", "TimestampNs", "TraceId", "SpanId", "ParentSpanId", "SpanName",
        "ServiceName", "Duration", "StatusCode",
        map_text("ResourceAttributes").alias("ResourceAttributes"),
        map_text("SpanAttributes").alias("SpanAttributes"))


@query
def to_bronze_metric(spark, sf):
    bronze = bridge.bronze(spark, sf)
    return _union(bronze[t].select(
        F.lit(t).alias("tbl"), "TimeUnix", "TimeUnixNs", "ServiceName", "MetricName", "Value",
        map_text("Attributes").alias("Attributes"))
        for t in ("otel_metrics_gauge", "otel_metrics_sum"))


@query
def route_metric(spark, sf):
    kept = VA.apply_policy(_validated(spark, sf), "warn")
    return _union(_count_rows(mapping.route_metric(kept, k), k) for k in ("gauge", "sum"))


@query
def operation_executions(spark, sf):
    return bridge.silver(spark, sf)["operation_executions"].drop(
        "resource_attributes", "operation_attributes", "event_date")


@query
def log_events(spark, sf):
    return bridge.silver(spark, sf)["log_events"].drop(
        "resource_attributes", "log_attributes", "event_date").withColumn(
        "severity_number", F.col("severity_number").cast("bigint"))


@query
def metric_observations(spark, sf):
    return bridge.silver(spark, sf)["metric_observations"].drop(
        "resource_attributes", "metric_attributes", "event_date", "start_time")


@query
def missing_dimensions(spark, sf):
    return S.missing_dimensions(bridge.silver(spark, sf)["operation_executions"]).groupBy(
        "scenario", "run_id", "service_name").agg(F.count("*").alias("n"))


@query
def real_data_tripwire(spark, sf):
    return S.real_data_tripwire(bridge.silver(spark, sf))


@query
def error_logs(spark, sf):
    return S.error_logs(bridge.silver(spark, sf)["log_events"])


@query
def log_search(spark, sf):
    return S.log_search(bridge.bronze(spark, sf)["otel_logs"], text="7}", severity="ERROR",
                        pattern="^error", attributes={C.KEY_COMPONENT_TYPE: "compute"})


@query
def trace_search(spark, sf):
    return S.trace_search(bridge.bronze(spark, sf)["otel_traces"], status="Error")


@query
def metric_series(spark, sf):
    b = bridge.bronze(spark, sf)
    out = S.metric_series(b["otel_metrics_gauge"], b["otel_metrics_sum"], width=WIDTH)
    return _round(out, "avg_value")


@query
def latest_runs(spark, sf):
    return S.latest_runs(VW.run_summary(bridge.silver(spark, sf)))


@query
def latest_health(spark, sf):
    return S.latest_health(VW.service_health_1m(
        bridge.silver(spark, sf)["operation_executions"], WIDTH))


@query
def latest_error_logs(spark, sf):
    return S.error_logs(bridge.silver(spark, sf)["log_events"], 5)


@query
def latest_metrics(spark, sf):
    return S.latest_metrics(bridge.silver(spark, sf)["metric_observations"])


@query
def latest_traces(spark, sf):
    return S.latest_traces(VW.trace_summary(bridge.silver(spark, sf)["operation_executions"]))


# -- joins --------------------------------------------------------------------


def _edges(spark, sf):
    return E.call_edges_1m(bridge.silver(spark, sf)["operation_executions"], width=WIDTH)


def _observed(spark, sf):
    return E.call_edges(bridge.bronze(spark, sf)["otel_traces"], limit=None)


@query
def call_edges_1m(spark, sf):
    return _edges(spark, sf)


@query
def call_edges(spark, sf):
    return E.call_edges(bridge.bronze(spark, sf)["otel_traces"])


@query
def call_edges_rollup(spark, sf):
    return E.call_edges_from_rollup(_edges(spark, sf))


@query
def call_edges_trailing_day(spark, sf):
    since = _as_of(spark, sf) - F.make_dt_interval(mins=F.lit(C.EDGE_WINDOW_MINUTES))
    return E.call_edges_1m(bridge.silver(spark, sf)["operation_executions"], since, WIDTH)


@query
def refresh_call_edges(spark, sf):
    """The trailing day of edges after three batches that part children from parents, each followed by a refresh."""
    root = _folder(spark)
    ops = bridge.silver(spark, sf)["operation_executions"]
    newest = bridge.read_events(spark, sf).agg(F.max("ts").alias("t"))
    for batch, hours in ((1, 12), (2, 5), (0, 0)):
        rows = ops.filter(F.pmod(F.xxhash64("span_id", "event_time_ns"), F.lit(3)) == batch)
        TB.write_piece(rows, root, "operation_executions", f"batch-{batch}")
        as_of = newest.select((F.col("t") - F.make_dt_interval(hours=F.lit(hours))).cast("string")).first()[0]
        jobs.refresh_call_edges(spark, root, as_of)
    return TB.read_table(spark, root, C.EDGE_TABLE).drop("event_date")


@query
def reconcile_counts(spark, sf):
    silver = bridge.silver(spark, sf)
    partial = {t: df.filter("is_synthetic") for t, df in silver.items()}
    return Q.reconcile_counts(R.volume_1m(partial, WIDTH), silver)


@query
def stddev_reconcile(spark, sf):
    mets = bridge.silver(spark, sf)["metric_observations"]
    out = Q.stddev_reconcile(R.metric_stats_1m(mets, WIDTH), mets, WIDTH)
    return out.select("window_start", "service_name", "metric_name",
                      F.round("from_rollup", 4).alias("from_rollup"),
                      F.round("from_raw", 4).alias("from_raw"))


def _ledger(spark, sf):
    """A phase-2 ledger in which every fourth day is still missing."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return bridge.read_events(spark, sf).select(
        day.alias("partition_id"), F.lit(BF.PHASE_2).alias("phase"),
        F.lit("metric_stats_1m").alias("target_table"),
        F.when(F.pmod(F.day("ts"), F.lit(4)) == 0, F.lit("failed")).otherwise(F.lit("ok"))
        .alias("status")).distinct()


def _day_range(spark, sf) -> tuple[str, str]:
    """The first and the last day of the data."""
    row = bridge.read_events(spark, sf).agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("a"),
                                            F.date_format(F.max("ts"), "yyyy-MM-dd").alias("b"))
    return tuple(row.first())


def _base_days(spark, sf):
    first, last = _day_range(spark, sf)
    return BF.partitions_present(bridge.bronze(spark, sf), first, last)


@query
def partitions_present(spark, sf):
    return _base_days(spark, sf)


@query
def missing_backfill_partitions(spark, sf):
    return BF.missing_backfill_partitions(_base_days(spark, sf), _ledger(spark, sf))


@query
def rollup_ready_gate(spark, sf):
    return BF.rollup_ready_gate(_base_days(spark, sf), _ledger(spark, sf))


@query
def undeclared_edges(spark, sf):
    return G.undeclared_edges(_observed(spark, sf), topology.read_topology(spark, bridge.declared(spark))[1])


@query
def undeclared_producers(spark, sf):
    return G.undeclared_producers(bridge.bronze(spark, sf), topology.read_topology(spark, bridge.declared(spark))[0])


@query
def declared_vs_observed_edges(spark, sf):
    out = G.declared_vs_observed_edges(_observed(spark, sf), topology.read_topology(spark, bridge.declared(spark))[1])
    return _round(out, "error_rate")


@query
def edge_health(spark, sf):
    out = G.edge_health(_observed(spark, sf), topology.read_topology(spark, bridge.declared(spark))[1])
    return _round(out, "share_of_peak", "error_rate")


@query
def declared_vs_measured(spark, sf):
    health = VW.service_health(VW.service_health_1m(
        bridge.silver(spark, sf)["operation_executions"], WIDTH), limit=None)
    out = G.declared_vs_measured(topology.read_topology(spark, bridge.declared(spark))[0], health)
    return _round(out, "p50_over_declared", "error_over_declared")


@query
def service_path(spark, sf):
    return B.service_path(bridge.bronze(spark, sf))


@query
def trace_detail_all(spark, sf):
    """Spans and logs of every trace."""
    b = bridge.bronze(spark, sf)
    return TR.trace_details(b["otel_traces"], b["otel_logs"], VW.trace_id_ts(b["otel_traces"]))


@query
def trace_detail(spark, sf):
    """Spans and logs of every trace that holds an error."""
    b = bridge.bronze(spark, sf)
    failing = b["otel_traces"].filter(F.col("StatusCode") == "Error").select("TraceId").distinct()
    lookup = VW.trace_id_ts(b["otel_traces"]).join(failing, "TraceId", "left_semi")
    return TR.trace_details(b["otel_traces"], b["otel_logs"], lookup)


@query
def logs_with_trace(spark, sf):
    s = bridge.silver(spark, sf)
    return TR.logs_with_trace(s["log_events"], s["operation_executions"])


# -- aggregates ---------------------------------------------------------------


@query
def trace_id_ts(spark, sf):
    return VW.trace_id_ts(bridge.bronze(spark, sf)["otel_traces"])


@query
def metric_rollup_1m(spark, sf):
    out = R.metric_rollup_direct(bridge.silver(spark, sf)["metric_observations"], WIDTH)
    return _round(out, "sum_value", "sum_squares", "avg_value", "stddev_value", digits=4)


@query
def metric_stats_1m(spark, sf):
    out = R.metric_stats_1m(bridge.silver(spark, sf)["metric_observations"], WIDTH)
    return _round(out.drop("event_date"), "sum_value", "sum_squares", digits=4)


def _two_partials(build, silver):
    """Partials of two slices of the data, as two batches would have left them."""
    a = {t: df.filter(F.pmod("event_time_ns", F.lit(2)) == 0) for t, df in silver.items()}
    b = {t: df.filter(F.pmod("event_time_ns", F.lit(2)) == 1) for t, df in silver.items()}
    return build(a).unionByName(build(b))


@query
def metric_rollup_merged(spark, sf):
    parts = _two_partials(lambda s: R.metric_stats_1m(s["metric_observations"], WIDTH),
                          bridge.silver(spark, sf))
    return _round(R.metric_rollup_merged(parts), "sum_value", "sum_squares", "avg_value",
                  "stddev_value", digits=4)


@query
def metric_stats_window(spark, sf):
    parts = R.metric_stats_1m(bridge.silver(spark, sf)["metric_observations"], WIDTH)
    return _round(R.metric_stats_window(parts), "sum_value", "sum_squares", "avg_value",
                  "stddev_value", digits=4)


@query
def bronze_metric_baseline(spark, sf):
    b = bridge.bronze(spark, sf)
    return _round(R.bronze_metric_baseline(b["otel_metrics_gauge"], b["otel_metrics_sum"],
                                           C.KEY_SCENARIO, WIDTH), "sum_val", "sum_sq", digits=4)


@query
def service_health_1m(spark, sf):
    out = VW.service_health_1m(bridge.silver(spark, sf)["operation_executions"], WIDTH)
    return _round(out, "error_rate")


@query
def service_health_daily(spark, sf):
    """The same model over (day, producer), where groups are large."""
    out = VW.service_health_1m(bridge.silver(spark, sf)["operation_executions"], "day",
                               ["window_start", "service_name"])
    return _round(out, "error_rate")


@query
def log_health_1m(spark, sf):
    out = VW.log_health_1m(bridge.silver(spark, sf)["log_events"], WIDTH)
    return _round(out.withColumn("max_severity_number",
                                 F.col("max_severity_number").cast("bigint")), "error_log_rate")


def _halves(silver: dict[str, DataFrame], table: str) -> list[DataFrame]:
    """A silver table as two batches that share minutes, producers and traces."""
    half = F.pmod(F.xxhash64("event_time_ns", "service_name"), F.lit(2))
    return [silver[table].filter(half == i) for i in (0, 1)]


@query
def log_health_merged(spark, sf):
    """The log model from the partials of two batches."""
    logs = _halves(bridge.silver(spark, sf), "log_events")
    return _round(P.log_health_merged(_union(P.log_counts_1m(x, WIDTH) for x in logs),
                                      _union(P.log_traces_1m(x, WIDTH) for x in logs)), "error_log_rate")


@query
def telemetry_coverage_merged(spark, sf):
    """What each component sent, from the partials of two batches."""
    silver = bridge.silver(spark, sf)
    batches = zip(*([(t, x) for x in _halves(silver, t)] for t in C.SILVER_TABLES))
    return P.telemetry_coverage_merged(_union(P.coverage_parts_1m(dict(b), WIDTH) for b in batches))


@query
def service_health_window(spark, sf):
    """True latency quantiles of each producer over the last ten days, from the slot counts of two batches."""
    ops = bridge.silver(spark, sf)["operation_executions"]
    parts = _union(P.latency_slots_1m(x) for x in _halves({"o": ops}, "o"))
    return P.service_health_window(parts, ops, _as_of(spark, sf) - F.make_dt_interval(days=F.lit(10)))


@query
def trace_summary(spark, sf):
    out = VW.trace_summary(bridge.silver(spark, sf)["operation_executions"])
    return _round(out.withColumn("services", F.array_join("services", ","))
                  .withColumn("components", F.array_join("components", ",")),
                  "trace_duration_ms")


@query
def telemetry_coverage_1m(spark, sf):
    return VW.telemetry_coverage_1m(bridge.silver(spark, sf), WIDTH)


@query
def run_summary(spark, sf):
    return VW.run_summary(bridge.silver(spark, sf))


@query
def volume_1m(spark, sf):
    return R.volume_1m(bridge.silver(spark, sf), WIDTH).drop("event_date")


def _presence(spark, sf):
    return R.resource_key_presence_1m(bridge.silver(spark, sf), WIDTH)


@query
def resource_key_presence_1m(spark, sf):
    return _presence(spark, sf).select("window_start", "service_name", "signal", "rows",
                                       map_text("key_counts").alias("key_counts"))


@query
def rows_missing_key(spark, sf):
    return R.rows_missing_key(_presence(spark, sf))


@query
def key_counts_bounded(spark, sf):
    return Q.key_counts_bounded(_presence(spark, sf))


@query
def merge_on_read(spark, sf):
    """Merged volume and key presence from two batches of partials."""
    silver = bridge.silver(spark, sf)
    volume = R.merge_volume(_two_partials(lambda s: R.volume_1m(s, WIDTH), silver))
    keys = R.merge_key_presence(_two_partials(
        lambda s: R.resource_key_presence_1m(s, WIDTH), silver))
    return volume.withColumnRenamed("rows", "volume_rows").join(
        keys, ["window_start", "service_name", "signal", "event_date"]).select(
        "window_start", "service_name", "signal", "volume_rows", "rows",
        map_text("key_counts").alias("key_counts"))


@query
def table_counts(spark, sf):
    return B.table_counts(bridge.bronze(spark, sf))


@query
def lineage(spark, sf):
    return B.lineage(bridge.bronze(spark, sf))


@query
def metric_inventory(spark, sf):
    return B.metric_inventory(bridge.bronze(spark, sf))


@query
def contract_violations(spark, sf):
    return B.contract_violations(bridge.bronze(spark, sf))


@query
def contract_violations_rollup(spark, sf):
    return B.contract_violations_from_rollup(_presence(spark, sf), bridge.bronze(spark, sf))


@query
def violation_share(spark, sf):
    return _round(B.violation_share(B.contract_violations(bridge.bronze(spark, sf))), "share")


def _band(spark, sf, limit=None):
    buckets = B.volume_buckets(bridge.bronze(spark, sf)["otel_logs"], _as_of(spark, sf), None,
                               BAND_WIDTH)
    return B.volume_band(buckets, limit)


def _series_text(df):
    point = F.transform("series", lambda p: F.concat_ws(":", p["t"].cast("string"),
                                                        p["n"].cast("string")))
    return df.withColumn("series", F.array_join(point, ","))


@query
def volume_band(spark, sf):
    return _series_text(_round(_band(spark, sf, 8), "sd"))


@query
def volume_band_rollup(spark, sf):
    rolled = R.volume_1m(bridge.silver(spark, sf), "hour")
    buckets = B.volume_buckets_from_rollup(rolled, _as_of(spark, sf), 7 * 24 * 60, "hour")
    return _series_text(_round(B.volume_band(buckets, 8), "sd"))


def _covered(spark, sf):
    """Days on which the models are taken to be complete: every second one."""
    return bridge.read_events(spark, sf).select(F.to_date("ts").alias("covered_day")).distinct().filter(
        F.pmod(F.datediff("covered_day", F.lit("2000-01-01").cast("date")), F.lit(2)) == 0)


def _on(df: DataFrame, covered: DataFrame) -> DataFrame:
    return df.join(covered, F.col("event_date") == F.col("covered_day"), "left_semi")


@query
def volume_band_stitched(spark, sf):
    """The band with half of its days from a model that has only these, the other half from the logs."""
    covered, bronze = _covered(spark, sf), bridge.bronze(spark, sf)
    model = _on(R.volume_1m(bridge.silver(spark, sf), "hour"), covered)
    buckets = B.volume_buckets_stitched(model, bronze["otel_logs"], covered, _as_of(spark, sf), 7 * 24 * 60, "hour")
    return _series_text(_round(B.volume_band(buckets, 8), "sd"))


@query
def call_edges_stitched(spark, sf):
    covered = _covered(spark, sf)
    model = E.call_edges_1m(bridge.silver(spark, sf)["operation_executions"]).withColumn(
        "event_date", F.to_date("window_start"))
    return E.call_edges_stitched(_on(model, covered), bridge.bronze(spark, sf)["otel_traces"], covered)


@query
def contract_violations_stitched(spark, sf):
    covered = _covered(spark, sf)
    sets = _on(R.key_sets_1m(bridge.silver(spark, sf), WIDTH), covered)
    return B.contract_violations_stitched(sets, bridge.bronze(spark, sf), covered)


@query
def key_presence_from_sets(spark, sf):
    return R.key_presence_from_sets(R.key_sets_1m(bridge.silver(spark, sf), WIDTH)).select(
        "window_start", "service_name", "signal", "rows", map_text("key_counts").alias("key_counts"))


@query
def service_health(spark, sf):
    out = VW.service_health(VW.service_health_1m(
        bridge.silver(spark, sf)["operation_executions"], WIDTH))
    return out


@query
def base_coverage(spark, sf):
    return B.base_coverage(bridge.silver(spark, sf))


@query
def latest_scenario(spark, sf):
    return B.latest_scenario(bridge.bronze(spark, sf)["otel_logs"])


@query
def model_counts(spark, sf):
    silver = bridge.silver(spark, sf)
    models = {**silver, "volume_1m": R.volume_1m(silver, WIDTH)}
    return B.model_counts(models, (*C.SILVER_TABLES, *C.ROLLUP_TABLES, C.EDGE_TABLE), spark).withColumn(
        "n", F.col("n").cast("string"))


@query
def content_checksum(spark, sf):
    """Row count and text hash per table, and whether the sums of single days add up to the row hash of the table."""
    parts = []
    for table, df in bridge.silver(spark, sf).items():
        sums = checksum.checksum_by_parts(df, F.col("event_date").cast("string"), text_hash=checksum.text_hash(
            "event_time_ns", "service_name", "scenario", "component_name"))
        here = {c: F.sum(F.when(F.col("whole"), F.col(c))) for c in ("rows", "content_hash", "text_hash")}
        parts.append(sums.agg(
            F.lit(table).alias("tbl"), F.coalesce(here["rows"], F.lit(0)).alias("rows"),
            (here["content_hash"] == F.sum(F.when(~F.col("whole"), F.col("content_hash")))).alias("stable"),
            F.coalesce(here["text_hash"], F.lit(0)).alias("text_hash")))
    return _union(parts)


@query
def piece_sums(spark, sf):
    """Rows by table and day from kept checksums after a compaction, and whether the stored rows hash to them."""
    root, parts = _folder(spark), []
    for table, df in bridge.silver(spark, sf).items():
        for i in range(2):
            TB.write_piece(df.filter(F.pmod("event_time_ns", F.lit(2)) == i), root, table, f"p{i}")
        SM.seal(spark, root, table)
        SM.compact(spark, root, table, "c1", TB.dates_of(spark, root, table))
        now = checksum.content_checksum(df.withColumn("_day", F.col("event_date").cast("string")), ["_day"], skip=("_day",))
        parts.append(SM.by_day(spark, root, table).join(now.toDF("day", "_n", "_h"), "day", "full").select(
            F.lit(table).alias("tbl"), "day", "rows", (F.col("rows").eqNullSafe(F.col("_n")) & F.col(
                "content_hash").eqNullSafe(F.col("_h"))).alias("agrees")))
    return _union(parts)


# -- scrapes ------------------------------------------------------------------


def _samples(spark, sf):
    return scrapes.read_scrapes(bridge.scrape_lines(spark, sf))


def _staged(spark, sf):
    """Samples parsed once into the shared folder, for work that reads them several times."""
    flat = TB.stage(_samples(spark, sf).drop("labels"), _folder(spark), "samples")
    return flat.withColumn("labels", scrapes.labels_of("label_key"))


def _metrics(spark, sf):
    """Rates from a tick table written to the shared folder first, as it is read twice."""
    return D.tick_metrics(TB.stage(D.tick_table(_samples(spark, sf)), _folder(spark), "ticks"))


@query
def scrape_value(spark, sf):
    samples = _samples(spark, sf)
    return D.scrape_values(samples, {
        "family": (C.METRIC_INGESTED, None), "series": (C.METRIC_INGESTED, {"signal": "metrics"}),
        "absent": ("no_such_family", None)})


@query
def scrape_sum_over(spark, sf):
    return D.scrape_sum_over(_samples(spark, sf), C.METRIC_REJECTED, "reason")


@query
def scrape_sum_over_pair(spark, sf):
    return D.scrape_sum_over_pair(_samples(spark, sf), C.METRIC_REJECTED, "reason", "signal")


@query
def histogram_quantile(spark, sf):
    out = D.histogram_quantile(_samples(spark, sf), C.METRIC_LATENCY,
                               {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return _round(out, "p50", "p90", "p99", digits=12)


@query
def counter_rate(spark, sf):
    return _round_product(D.counter_rate(_staged(spark, sf)), "rate")


@query
def live_counter_rate(spark, sf):
    """The same from a stream that is stopped half way and started again; a last tick far ahead lets all others leave."""
    root = _folder(spark)
    # Each half is parsed straight into the folder that the stream reads; the events tell the times.
    samples = _samples(spark, sf).select(*D.SERIES, "scrape_ts", "value")
    span = bridge.read_events(spark, sf).agg(F.percentile_approx("ts", 0.5).alias("half"), F.max("ts").alias("last")).first()
    end = [[("end", "end", "", span["last"] + dt.timedelta(days=2, seconds=i), 0.0)] for i in range(2)]
    parts = [samples.where(F.col("scrape_ts") <= F.lit(span["half"])), samples.where(F.col("scrape_ts") > F.lit(span["half"])),
             *[spark.createDataFrame(e, samples.schema) for e in end]]
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        live = rates.live_rates(spark.readStream.schema(samples.schema).parquet(f"{root}/in"), idle_seconds=30 * 86400)
        live.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(
            f"{root}/out").awaitTermination()
    return _round_product(spark.read.schema(live.schema).parquet(f"{root}/out").where("name <> 'end'"), "rate")


@query
def rate_by_label(spark, sf):
    return D.rate_by_label(_staged(spark, sf), C.METRIC_INGESTED, ["signal"], 6)


@query
def reject_rate_matrix(spark, sf):
    return D.rate_by_label(_staged(spark, sf), C.METRIC_REJECTED, ["reason", "signal"], 6)


@query
def table_growth(spark, sf):
    """Growth of each event kind, read as a table whose rows are counted at every event."""
    events = bridge.read_events(spark, sf).select(F.col("ts").alias("read_at"), F.col("event_type").alias("tbl"), "event_id")
    counted = running(events, ["tbl"], "read_at", {"n": F.lit(1).cast("long")}, ("event_id",))
    return D.table_growth(counted.select("tbl", "read_at", "n"))


@query
def flush_stats(spark, sf):
    return D.flush_stats(_metrics(spark, sf))


@query
def storage_rates(spark, sf):
    return D.storage_rates(_metrics(spark, sf))


@query
def delivery_mode(spark, sf):
    return D.delivery_mode(_metrics(spark, sf)).select(*D.TICK, "flush_rate", "mode")


@query
def mode_segments(spark, sf):
    return D.mode_segments(D.delivery_mode(_metrics(spark, sf)))


@query
def mode_segments_all(spark, sf):
    """Every run of equal mode since the first tick."""
    return D.mode_segments(D.delivery_mode(_metrics(spark, sf)), None)


@query
def history_stats(spark, sf):
    out = D.history_stats(_metrics(spark, sf))
    return _round(out, "ingest_mean", "stored_mean", "flush_mean", "reject_mean")


@query
def totals(spark, sf):
    return D.totals(_samples(spark, sf))


@query
def delivery_verdict(spark, sf):
    return D.delivery_verdict(_metrics(spark, sf)).select(*D.TICK, "state", "note")


@query
def strict_counterfactual(spark, sf):
    metrics = _metrics(spark, sf)
    return _round(D.strict_counterfactual(metrics, "warn"), "share_of_throughput")


# -- verdicts and gates -------------------------------------------------------


def _verdicts(spark, sf):
    return V.volume_state(_band(spark, sf))


@query
def volume_state(spark, sf):
    return _round(_verdicts(spark, sf).drop("series"), "sd")


@query
def oob_share(spark, sf):
    return _band(spark, sf).select("service", F.round(V.oob_share(
        "series", "median", F.col("mad") * C.MAD_TO_SIGMA), 6).alias("mad_share"),
        F.round(V.oob_share("series", "median", "sd"), 6).alias("sd_share"))


@query
def out_of_band_points(spark, sf):
    return V.out_of_band_points(_verdicts(spark, sf))


@query
def volume_board(spark, sf):
    return B.volume_board(_verdicts(spark, sf)).select(
        "severity", "service", "state", "absent", "median", "why")


@query
def volume_tally(spark, sf):
    return B.volume_tally(_verdicts(spark, sf))


@query
def producer_health(spark, sf):
    return B.producer_health(_verdicts(spark, sf),
                             B.contract_violations(bridge.bronze(spark, sf), limit=None))


def _coverage(spark, sf):
    return B.base_coverage(bridge.silver(spark, sf))


@query
def coverage_gate(spark, sf):
    coverage, as_of = _coverage(spark, sf), _as_of(spark, sf)
    cases = [("volume 60 min", C.SILVER_TABLES, 60, None),
             ("volume 60 days", C.SILVER_TABLES, 60 * 24 * 60, None),
             ("edges 15 min", C.SILVER_TABLES[:1], 15, C.EDGE_WINDOW_MINUTES),
             ("edges 25 h", C.SILVER_TABLES[:1], 25 * 60, C.EDGE_WINDOW_MINUTES)]
    return _union(B.coverage_gate(coverage, t, m, as_of, longest).withColumn("case", F.lit(n))
                  for n, t, m, longest in cases)


@query
def fallback_removal_ready(spark, sf):
    """Daily coverage readings: what was the oldest event each time one was taken."""
    readings = bridge.read_events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(
        F.max("ts").alias("read_at"), F.min("ts").alias("oldest"))
    as_of = _as_of(spark, sf)
    return _union(B.fallback_removal_ready(readings, as_of, 7, d).withColumn(
        "days", F.lit(d)) for d in (0, 30))


# -- checks -------------------------------------------------------------------


@query
def check_base_models(spark, sf):
    return Q.check_base_models(spark, bridge.bronze(spark, sf), bridge.silver(spark, sf))


@query
def check_read_models(spark, sf):
    return Q.check_read_models(spark, bridge.silver(spark, sf), WIDTH)


@query
def check_metric_stats(spark, sf):
    mets = bridge.silver(spark, sf)["metric_observations"]
    out = Q.check_metric_stats(spark, R.metric_stats_1m(mets, WIDTH), mets, WIDTH, 1e-4)
    return out.select("check", "ok")


@query
def check_tripwire(spark, sf):
    return Q.check_tripwire(spark, bridge.silver(spark, sf))


@query
def check_volume(spark, sf):
    silver = bridge.silver(spark, sf)
    return Q.check_volume(spark, R.volume_1m(silver, WIDTH), silver)


@query
def check_key_presence(spark, sf):
    return Q.check_key_presence(spark, _presence(spark, sf), bridge.bronze(spark, sf),
                                C.KEY_SERVICE)


@query
def check_call_edges(spark, sf):
    return Q.check_call_edges(spark, _edges(spark, sf),
                              bridge.silver(spark, sf)["operation_executions"],
                              topology.read_topology(spark, bridge.declared(spark))[1])


@query
def summary_counts(spark, sf):
    return Q.summary_counts(spark, bridge.silver(spark, sf), WIDTH)


# -- jobs ---------------------------------------------------------------------


@query
def stream_ingest(spark, sf):
    """All signals through the stream, then the merged volume of what it stored."""
    root = _folder(spark)
    bridge.signal_lines(spark, sf).select("value").write.text(f"{root}/in")
    job = jobs.stream_ingest(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", once=True)
    job.awaitTermination()
    merged = jobs.merge_on_read(spark, f"{root}/out")["volume_1m"]
    return merged.groupBy("event_date", "service_name", "signal").agg(
        F.sum("rows").alias("rows")).select(F.col("event_date").cast("string").alias("day"),
                                            "service_name", "signal", "rows")


@query
def stream_totals(spark, sf):
    """What the stream counted of itself over several batches: its last tick."""
    root = _folder(spark)
    bridge.signal_lines(spark, sf).select("value").repartition(2).write.text(f"{root}/in")
    jobs.stream_ingest(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", once=True, max_files=1).awaitTermination()
    ticks = delivery.read_stream_ticks(spark, f"{root}/out")
    names = ["ingested", "accepted", "rejected", "flushes", "export_errors",
             *(f"{n}_{x}" for x in C.SIGNAL_LANES for n in ("in", "rj"))]
    return ticks.groupBy("instance").agg(*[F.max_by(n, "scrape_ts").cast("long").alias(n) for n in names])


@query
def live_partition_refusal(spark, sf):
    """What the ledger says about a range that reaches the newest day."""
    root = _folder(spark)
    day = bridge.read_events(spark, sf).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("d")).first()["d"]
    try:
        BF.backfill_base(spark, root, "1970-01-01", day, day, "r1")
    except BF.BackfillRefused:
        pass
    return BF.read_ledger(spark, root).select("phase", "target_table", "partition_id", "status")


@query
def backfill(spark, sf):
    """Both phases over all complete days; the ledger they leave."""
    root = _folder(spark)
    for table, rows in bridge.bronze(spark, sf).items():
        TB.write_piece(rows, root, table, "all")
    last = bridge.read_events(spark, sf).agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("d"),
        F.date_format(F.date_sub(F.max("ts"), 1), "yyyy-MM-dd").alias("y")).first()
    BF.backfill_base(spark, root, last["first"], last["y"], last["d"], "r1")
    BF.backfill_rollups(spark, root, last["first"], last["y"], last["d"], "r2")
    ledger = BF.read_ledger(spark, root).filter(F.col("status") == "ok")
    return ledger.select("phase", "target_table", "partition_id", "silver_rows_written",
                         (F.col("content_hash") == F.col("expected_hash")).alias("agrees"))
