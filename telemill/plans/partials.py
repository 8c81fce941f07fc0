"""Partials of the health, log and coverage models, and the models merged from them.

A batch adds its own partials; any number of them for one key merge exactly.  Latencies are counted by the
logarithmic slot of ``functions.quantiles``; over any window the slot counts say which slots hold the wanted positions, and
only the spans of those slots are read again.  Distinct traces merge as rows (as a HyperLogLog sketch
where an estimate will do), distinct metric names as small sets, which the contract bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill.functions.columns import bucket
from telemill.functions.quantiles import from_slots, slot_of
from telemill.plans.rollups import key_sets_1m, merge_key_sets
from telemill.plans.views import HEALTH_KEYS

QUANTILES = {"p50": (50, 100), "p95": (95, 100), "p99": (99, 100)}
LOG_KEYS = ["window_start", "scenario", "service_name", "component_name"]
COVERAGE_KEYS = ["window_start", "scenario", "run_id", "service_name", "component_name"]


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("window_start"))


# -- latencies ----------------------------------------------------------------


def latency_slots_1m(operations: DataFrame, width: str = "minute") -> DataFrame:
    return _dated(operations.withColumn("window_start", bucket("event_time", width)).groupBy(
        *HEALTH_KEYS, slot_of("duration_ns").cast("long").alias("slot")).agg(
        F.count("*").alias("operations"), F.count_if("is_error").alias("errors"), F.max("duration_ns").alias("highest_ns")))


def merge_latency_slots(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*HEALTH_KEYS, "slot", "event_date").agg(
        F.sum("operations").alias("operations"), F.sum("errors").alias("errors"), F.max("highest_ns").alias("highest_ns"))


def _since(df: DataFrame, time: str, first) -> DataFrame:
    if first is None:
        return df
    first = F.date_trunc("minute", F.lit(first).cast("timestamp") if not isinstance(first, Column) else first)
    return df.filter((F.col(time) >= first) & (F.col("event_date") >= F.to_date(first)))


def service_health_window(partials: DataFrame, operations: DataFrame, since=None, keys: tuple[str, ...] = ("service_name",),
                          limit: int | None = None) -> DataFrame:
    """True quantiles per producer (or any of the partials' keys) over all minutes from ``since`` on.

    Quantiles of a window are no function of the minutes' quantiles, so they come from the merged slots.  Of ``operations``
    only spans in a slot that holds a wanted position take part: three slots a producer at most.
    """
    keys = list(keys)
    slots = _since(partials, "window_start", since).groupBy(*keys, F.col("slot").alias("_slot")).agg(
        F.sum("operations").alias("_w"), F.max("highest_ns").alias("_hi"), F.sum("errors").alias("_f_errors"))
    values = _since(operations, "event_time", since).groupBy(
        *keys, slot_of("duration_ns").cast("long").alias("_slot"), F.col("duration_ns").alias("_v")).agg(F.count("*").alias("_w"))
    out = from_slots(slots, values, keys, QUANTILES, count="ops", maximum="_highest", flags=("errors",))
    out = out.select(
        *keys, "ops", "errors", *[(F.col(q) / 1000000.0).alias(q) for q in QUANTILES],
        (F.col("_highest") / 1000000.0).alias("worst"), F.round(F.col("errors") / F.col("ops"), 5).alias("error_rate"))
    return out if limit is None else out.orderBy(F.desc("ops"), *keys).limit(limit)


# -- logs ---------------------------------------------------------------------


def log_counts_1m(logs: DataFrame, width: str = "minute") -> DataFrame:
    return _dated(logs.withColumn("window_start", bucket("event_time", width)).groupBy(*LOG_KEYS).agg(
        F.count("*").alias("log_count"), F.count_if("is_error").alias("error_log_count"),
        F.max("severity_number").alias("max_severity_number"), # A sketch passes over empty texts, and the empty id counts as one.
        F.hll_sketch_agg(F.xxhash64("trace_id")).alias("traces_sketch")))


def merge_log_counts(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*LOG_KEYS, "event_date").agg(
        F.sum("log_count").alias("log_count"), F.sum("error_log_count").alias("error_log_count"),
        F.max("max_severity_number").alias("max_severity_number"), F.hll_union_agg("traces_sketch").alias("traces_sketch"))


def log_traces_1m(logs: DataFrame, width: str = "minute") -> DataFrame:
    return _dated(logs.select(bucket("event_time", width).alias("window_start"), *LOG_KEYS[1:], "trace_id").distinct())


def merge_log_traces(partials: DataFrame) -> DataFrame:
    return partials.distinct()


def log_health_merged(counts: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """The log model from partials; without ``traces`` the distinct count is the sketch's estimate."""
    merged = merge_log_counts(counts)
    if traces is None:
        merged = merged.withColumn("affected_trace_count", F.hll_sketch_estimate("traces_sketch"))
    else:
        distinct = merge_log_traces(traces).groupBy(*[F.col(k).alias(f"_{k}") for k in LOG_KEYS]).agg(
            F.count("*").alias("affected_trace_count"))
        same = F.lit(True)
        for k in LOG_KEYS:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        merged = merged.join(distinct, same)
    return merged.select(
        *LOG_KEYS, "log_count", "error_log_count", "max_severity_number", "affected_trace_count",
        (F.col("error_log_count") / F.col("log_count")).alias("error_log_rate"))


# -- coverage -----------------------------------------------------------------


def coverage_parts_1m(silver: dict[str, DataFrame], width: str = "minute") -> DataFrame:
    def part(table: str, signal: str) -> DataFrame:
        name = F.col("metric_name") if table == "metric_observations" else F.lit(None).cast("string")
        return silver[table].groupBy(
            bucket("event_time", width).alias("window_start"), *COVERAGE_KEYS[1:], name.alias("name")).agg(
            F.count("*").alias("n")).withColumn("signal", F.lit(signal))

    rows = part("operation_executions", "span").unionByName(part("log_events", "log")).unionByName(
        part("metric_observations", "metric"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("signal") == s, F.col("n"))), F.lit(0))
    return _dated(rows.groupBy(*COVERAGE_KEYS).agg(
        of("span").alias("span_count"), of("log").alias("log_count"), of("metric").alias("metric_count"),
        F.sort_array(F.collect_set(F.when(F.col("name") != "", F.col("name")))).alias("metric_names")))


def merge_coverage(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*COVERAGE_KEYS, "event_date").agg(
        *[F.sum(c).alias(c) for c in ("span_count", "log_count", "metric_count")],
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("metric_names")))).alias("metric_names"))


def telemetry_coverage_merged(partials: DataFrame) -> DataFrame:
    return merge_coverage(partials).select(
        *COVERAGE_KEYS, "span_count", "log_count", "metric_count",
        F.size("metric_names").cast("long").alias("metric_name_count"))


def all_partials(silver: dict[str, DataFrame], width: str = "minute") -> dict[str, DataFrame]:
    return {"latency_slots_1m": latency_slots_1m(silver["operation_executions"], width),
            "log_counts_1m": log_counts_1m(silver["log_events"], width),
            "log_traces_1m": log_traces_1m(silver["log_events"], width),
            "coverage_parts_1m": coverage_parts_1m(silver, width), "key_sets_1m": key_sets_1m(silver, width)}


MERGERS = {"latency_slots_1m": merge_latency_slots, "log_counts_1m": merge_log_counts,
           "log_traces_1m": merge_log_traces, "coverage_parts_1m": merge_coverage, "key_sets_1m": merge_key_sets}
SOURCES = {"latency_slots_1m": ("operation_executions",), "log_counts_1m": ("log_events",),
           "log_traces_1m": ("log_events",),
           "coverage_parts_1m": ("operation_executions", "log_events", "metric_observations"),
           "key_sets_1m": ("operation_executions", "log_events", "metric_observations")}
