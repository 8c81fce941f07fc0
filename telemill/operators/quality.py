"""Conservation checks as rows ``(check, observed, expected, ok)``.

Both sides of a check are scalar subqueries, so a whole suite is one query whose parts run
as ordinary distributed aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telemill.functions.columns import has_key, one_value
from telemill.plans import rollups, views

EQ, LE, GT = "=", "<=", ">"


@dataclass(frozen=True)
class Check:
    name: str
    observed: Column
    relation: str
    expected: Column


def _num(c) -> Column:
    c = c if isinstance(c, Column) else F.lit(c)
    return F.coalesce(c.cast("double"), F.lit(0.0))


def as_rows(spark: SparkSession, checks: list[Check]) -> DataFrame:
    structs = [F.struct(F.lit(c.name).alias("check"), _num(c.observed).alias("observed"),
                        F.lit(c.relation).alias("relation"), _num(c.expected).alias("expected"))
               for c in checks]
    rows = spark.range(1).select(F.inline(F.array(*structs)))
    o, e, r = F.col("observed"), F.col("expected"), F.col("relation")
    return rows.withColumn("ok", F.when(r == EQ, o == e).when(r == LE, o <= e).otherwise(o > e))


def assert_all(checks: DataFrame) -> None:
    """Fail-fast form: raises with the names of the broken checks (few rows by nature)."""
    bad = [r["check"] for r in checks.filter(~F.col("ok")).collect()]
    if bad:
        raise AssertionError("failed checks: " + "; ".join(bad))


def _n(df: DataFrame) -> Column:
    return one_value(df, F.count("*"))


def _sum(df: DataFrame, column: str) -> Column:
    return one_value(df, F.coalesce(F.sum(column), F.lit(0)))


def _if(df: DataFrame, cond) -> Column:
    return one_value(df, F.count_if(cond))


def check_base_models(spark: SparkSession, bronze, silver) -> DataFrame:
    ops, logs, mets = (silver[t] for t in
                       ("operation_executions", "log_events", "metric_observations"))
    missing = ((F.col("scenario") == "") | (F.col("run_id") == "")
               | (F.col("service_name") == "") | (F.col("contract_version") == ""))
    return as_rows(spark, [
        *[Check(f"{t} is not empty", _n(df), GT, F.lit(0)) for t, df in silver.items()],
        Check("spans conserved", _n(ops), EQ, _n(bronze["otel_traces"])),
        Check("points conserved", _n(mets), EQ,
              _n(bronze["otel_metrics_gauge"]) + _n(bronze["otel_metrics_sum"])),
        Check("logs conserved", _n(logs), EQ, _n(bronze["otel_logs"])),
        Check("span dimensions present", _if(ops, missing), EQ, F.lit(0)),
        Check("no negative duration", _if(ops, F.col("duration_ms") < 0), EQ, F.lit(0)),
    ])


def check_read_models(spark: SparkSession, silver, width: str = "minute") -> DataFrame:
    ops, logs, mets = (silver[t] for t in
                       ("operation_executions", "log_events", "metric_observations"))
    coverage = views.telemetry_coverage_1m(silver, width)
    runs = views.run_summary(silver)
    traces = ops.filter(F.col("trace_id") != "")
    checks = [
        Check("metric rollup covers all points",
              _sum(rollups.metric_rollup_direct(mets, width), "sample_count"), EQ, _n(mets)),
        Check("service health covers all spans",
              _sum(views.service_health_1m(ops, width), "operation_count"), EQ, _n(ops)),
        Check("log health covers all logs",
              _sum(views.log_health_1m(logs, width), "log_count"), EQ, _n(logs)),
        Check("one summary per trace", _n(views.trace_summary(ops)), EQ,
              one_value(traces, F.count_distinct("trace_id"))),
    ]
    for view, name in ((coverage, "coverage"), (runs, "run summary")):
        for column, df in (("span_count" if name == "coverage" else "operation_count", ops),
                           ("log_count", logs), ("metric_count", mets)):
            checks.append(Check(f"{name} {column} covers all rows", _sum(view, column), EQ,
                                _n(df)))
    return as_rows(spark, checks)


def stddev_reconcile(partials: DataFrame, observations: DataFrame,
                     width: str = "minute") -> DataFrame:
    """Deviation from the rollup beside the one from the raw values, per three keys."""
    keys = ["window_start", "service_name", "metric_name"]
    rolled = rollups.with_moments(rollups.merge_metric_stats(partials, keys)).select(
        *keys, F.col("stddev_value").alias("from_rollup"))
    raw = observations.withColumn("window_start", F.date_trunc(width, "event_time")).groupBy(
        *keys).agg(F.stddev_pop("value").alias("from_raw"))
    return rolled.join(raw, keys).withColumn(
        "difference", F.abs(F.col("from_rollup") - F.col("from_raw")))


def check_metric_stats(spark: SparkSession, partials, observations,
                       width: str = "minute", tolerance: float = 1e-9) -> DataFrame:
    return as_rows(spark, [
        Check("samples conserved", _sum(partials, "sample_count"), EQ, _n(observations)),
        Check("deviation agrees", one_value(stddev_reconcile(partials, observations, width),
                                            F.max("difference")), LE, F.lit(tolerance)),
    ])


def check_tripwire(spark: SparkSession, silver) -> DataFrame:
    return as_rows(spark, [
        Check(f"only synthetic rows in {t}", _if(df, ~F.col("is_synthetic")), EQ, F.lit(0))
        for t, df in silver.items()])


def reconcile_counts(volume: DataFrame, silver) -> DataFrame:
    """Producers whose rollup count differs from the base count; a missing side counts 0."""
    rolled = volume.groupBy("signal", "service_name").agg(F.sum("rows").alias("rolled"))
    base = None
    for table, signal in rollups.SIGNAL_OF.items():
        part = silver[table].select(F.lit(signal).alias("signal"), "service_name")
        base = part if base is None else base.unionByName(part)
    base = base.groupBy("signal", "service_name").agg(F.count("*").alias("base"))
    both = rolled.join(base, ["signal", "service_name"], "full_outer")
    return both.select("signal", "service_name", F.coalesce("rolled", F.lit(0)).alias("rolled"),
                       F.coalesce("base", F.lit(0)).alias("base")).filter(
        F.col("rolled") != F.col("base"))


def check_volume(spark: SparkSession, volume, silver) -> DataFrame:
    """One line per signal: how many producers differ.  The comparison runs once."""
    found = reconcile_counts(volume, silver).agg(*[
        F.count_if(F.col("signal") == s).cast("double").alias(s) for s in ("log", "trace", "metric")])
    lines = F.array(*[F.struct(F.lit(f"volume agrees for {s}").alias("check"),
                               F.col(s).alias("observed"), F.lit(EQ).alias("relation"),
                               F.lit(0.0).alias("expected")) for s in ("log", "trace", "metric")])
    return found.select(F.inline(lines)).withColumn("ok", F.col("observed") == F.col("expected"))


def key_counts_bounded(partials: DataFrame) -> DataFrame:
    """Number of merged key counts that exceed the rows of their bucket."""
    merged = rollups.merge_key_presence(partials, rollups.VOLUME_KEYS)
    return merged.select("rows", F.explode(F.map_values("key_counts")).alias("n")).agg(
        F.count_if(F.col("n") > F.col("rows")).alias("violations"))


def check_key_presence(spark: SparkSession, partials, bronze, key: str) -> DataFrame:
    merged = rollups.merge_key_presence(partials.withColumn("_all", F.lit(1)), ["_all"])
    absent = F.col("rows") - F.coalesce(F.try_element_at("key_counts", F.lit(key)), F.lit(0))
    probe = None
    for df in bronze.values():
        part = df.select("ResourceAttributes")
        probe = part if probe is None else probe.unionByName(part)
    return as_rows(spark, [
        Check("key counts never exceed rows", key_counts_bounded(partials).scalar(), EQ,
              F.lit(0)),
        Check(f"rows missing {key} agree", one_value(merged, F.sum(absent)), EQ,
              _if(probe, ~has_key("ResourceAttributes", key))),
    ])


def check_call_edges(spark: SparkSession, edges, operations, declared_edges) -> DataFrame:
    pairs = declared_edges.select("src_service", "dst_service").distinct()
    return as_rows(spark, [
        Check("edges are not empty", _n(edges), GT, F.lit(0)),
        Check("no self edges", _if(edges, F.col("src_service") == F.col("dst_service")), EQ,
              F.lit(0)),
        Check("only declared edges",
              _n(edges.join(pairs, ["src_service", "dst_service"], "left_anti")), EQ, F.lit(0)),
        Check("no fan-out", _sum(edges, "spans"), LE,
              _if(operations, F.col("parent_span_id") != "")),
        Check("errors within spans", _if(edges, F.col("errors") > F.col("spans")), EQ,
              F.lit(0)),
    ])


def summary_counts(spark: SparkSession, silver, width: str = "minute") -> DataFrame:
    """Row counts of every model in one row."""
    ops, logs, mets = (silver[t] for t in
                       ("operation_executions", "log_events", "metric_observations"))
    counts = {
        "operation_executions": ops, "log_events": logs, "metric_observations": mets,
        "metric_rollup_windows": rollups.metric_rollup_direct(mets, width),
        "service_health_windows": ops.select(
            F.date_trunc(width, "event_time").alias("window_start"),
            *views.HEALTH_KEYS[1:]).distinct(),
        "log_health_windows": logs.select(
            F.date_trunc(width, "event_time").alias("window_start"), "scenario",
            "service_name", "component_name").distinct(),
        "traces": views.trace_summary(ops),
        "coverage_windows": views.telemetry_coverage_1m(silver, width),
        "runs": views.run_summary(silver),
    }
    return spark.range(1).select(*[_n(df).alias(n) for n, df in counts.items()])

