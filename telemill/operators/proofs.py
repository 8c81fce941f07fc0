"""Facts by which a rebuilt day is compared with what it was built from.

Nothing is built a second time.  Both sides are read once and reduced to a few additive numbers a day:

* A silver row *carries* columns of its bronze row.  Each carried column is hashed together with the row's nanosecond, and
  the hashes are summed; equal sums mean equal columns, and a difference names the column.
* Its other columns must *follow* from the carried ones of the same row; rows that break a rule are counted.
* A rollup row stands for ``n`` source rows: the sum of ``n`` times the hash of its keys is the sum of the hashes of the keys
  of the source rows, whatever the groups.  Sums of values are weighted by the keys in the same way, and compared to the
  size of the numbers added.  Only extremes need the source in groups.

Hashes keep 26 bits, so that a long holds the sum over 10^11 rows a day; more raise an overflow.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, functions as F

from telemill import contract as C
from telemill.functions.checksum import row_hash
from telemill.plans.rollups import SIGNAL_OF
from telemill.sources.tables import date_column

BITS = 26
#: Facts that describe one side only.
ONE_SIDED = ("stored_rows", "source_rows", "source_hash")

_R = "resource_attributes"
#: Silver column: the bronze column it carries, by bronze table.
CARRIED = {
    "otel_logs": {
        "event_time": "Timestamp", "event_time_ns": "TimestampNs", "service_name": "ServiceName", "body": "Body",
        "severity_text": "SeverityText", "severity_number": "SeverityNumber", "trace_id": "TraceId",
        "span_id": "SpanId", _R: "ResourceAttributes", "log_attributes": "LogAttributes"},
    "otel_traces": {
        "event_time": "Timestamp", "event_time_ns": "TimestampNs", "service_name": "ServiceName",
        "operation_name": "SpanName", "trace_id": "TraceId", "span_id": "SpanId", "parent_span_id": "ParentSpanId",
        "duration_ns": "Duration", "status_code": "StatusCode", _R: "ResourceAttributes",
        "operation_attributes": "SpanAttributes"},
    "otel_metrics_gauge": (_METRIC := {
        "event_time": "TimeUnix", "event_time_ns": "TimeUnixNs", "start_time": "StartTimeUnix",
        "service_name": "ServiceName", "metric_name": "MetricName", "value": "Value", _R: "ResourceAttributes",
        "metric_attributes": "Attributes"}),
    "otel_metrics_sum": _METRIC,
}
#: Own attributes of a silver table's rows.
OWN = {"log_events": "log_attributes", "operation_executions": "operation_attributes",
       "metric_observations": "metric_attributes"}
#: Texts that follow from a map of the same row: column, whether the map is the resource's, key.
TEXTS = (("scenario", True, C.KEY_SCENARIO), ("run_id", True, C.KEY_RUN_ID), ("cloud_provider", True, C.KEY_PROVIDER),
         ("contract_version", True, C.KEY_CONTRACT_VERSION), ("component_name", False, C.KEY_COMPONENT_NAME),
         ("component_type", False, C.KEY_COMPONENT_TYPE), ("status", False, "status"))
#: Keys and the number of source rows of each rollup.
KEYS = {"metric_stats_1m": ("scenario", "service_name", "component_name", "metric_name", "metric_kind"),
        "volume_1m": ("service_name", "signal"), "resource_key_presence_1m": ("service_name", "signal")}
COUNT = {"metric_stats_1m": "sample_count", "volume_1m": "rows", "resource_key_presence_1m": "rows"}


def _digest(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - BITS)


def _flat(df: DataFrame, name: str) -> Column:
    """A column as something that can be hashed: maps as their sorted entries."""
    is_map = df.schema[name].dataType.typeName() == "map"
    return F.sort_array(F.map_entries(name)) if is_map else F.col(name)


def _day(table: str) -> Column:
    return F.col(date_column(table)).cast("string").alias("day")


def _own_size(df: DataFrame) -> list[Column]:
    return [F.count("*").alias("source_rows"), F.sum(row_hash(df).cast("decimal(28,0)")).alias("source_hash")]


def _unit(given: str | None, attributes: str) -> Column:
    """Digest of a unit: the one given, else the attribute's."""
    own = F.try_element_at(F.col(attributes), F.lit("unit"))
    return F.coalesce(F.nullif(F.col(given), F.lit("")), own, F.lit(""))


def _kind(text: str) -> Column:
    return F.sum((F.col("metric_kind") == text).cast("long")).alias(f"kind_{text}")


def bronze_facts(name: str, rows: DataFrame) -> DataFrame:
    """What a bronze table says about its silver rows, a row a day."""
    ns = F.col(CARRIED[name]["event_time_ns"])
    facts = [F.sum(_digest(ns, _flat(rows, b))).alias(f"col_{s}") for s, b in CARRIED[name].items()]
    if name.startswith("otel_metrics_"):
        facts += [F.sum(_digest(ns, _unit("MetricUnit", "Attributes"))).alias("col_metric_unit"),
                  F.count("*").alias(f"kind_{name.rsplit('_', 1)[1]}")]
    return rows.groupBy(_day(name)).agg(F.count("*").alias("rows"), *facts, *_own_size(rows))


def _rules(table: str) -> dict[str, Column]:
    """Whether a silver row's other columns follow from those it carries."""
    text = lambda m, key: F.coalesce(F.try_element_at(F.col(m), F.lit(key)), F.lit(""))
    rules = {c: F.col(c).eqNullSafe(text(_R if resource else OWN[table], key)) for c, resource, key in TEXTS
             if (c != "component_type" or table != "log_events") and (c != "status" or table == "metric_observations")}
    rules["is_synthetic"] = F.col("is_synthetic").eqNullSafe(F.lower(text(_R, C.KEY_SYNTHETIC)).eqNullSafe(F.lit("true")))
    if table == "log_events":
        severe = (F.col("severity_number") >= C.ERROR_SEVERITY_NUMBER) | F.upper("severity_text").isin(
            *C.ERROR_SEVERITY_TEXTS)
        rules["is_error"] = F.col("is_error").eqNullSafe(severe)
    if table == "operation_executions":
        rules["is_error"] = F.col("is_error").eqNullSafe(F.col("status_code") == "Error")
        rules["end_time_ns"] = (F.col("end_time_ns") - F.col("duration_ns")).eqNullSafe(F.col("event_time_ns"))
        past = F.col("end_time_ns") - F.unix_micros("end_time") * 1000
        rules["end_time"] = F.col("end_time").isNull().eqNullSafe(F.col("end_time_ns").isNull()) & F.coalesce(
            past.between(0, 999), F.lit(True))
        rules["duration_ms"] = F.col("duration_ms").eqNullSafe(F.col("duration_ns") / 1e6)
    return rules


def silver_facts(table: str, rows: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """The same of stored silver rows, and how many of them break which rule."""
    ns = F.col("event_time_ns")
    facts = [F.sum(_digest(ns, _flat(rows, s))).alias(f"col_{s}") for s in CARRIED[sources[0]]]
    if table == "metric_observations":
        facts += [F.sum(_digest(ns, F.col("metric_unit"))).alias("col_metric_unit"), _kind("gauge"), _kind("sum")]
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"broken_{c}") for c, rule in _rules(table).items()]
    return rows.groupBy(_day(table)).agg(
        F.count("*").alias("rows"), F.count("*").alias("stored_rows"), *facts, *broken)


# -- rollups ------------------------------------------------------------------


def _minute(time: str) -> Column:
    """Number of the minute, counted from the epoch."""
    return F.floor(F.unix_micros(time) / F.lit(60_000_000)).cast("long")


def _weighted(h: Column, n: Column, value: Column, square: Column) -> list[Column]:
    w = h / float(1 << BITS) + 1
    return [F.sum(w * value).alias("total_value"), F.sum(w * square).alias("total_square"),
            F.sum(n).alias("rows"), F.sum(n * h).alias("groups")]


def _extremes(groups: DataFrame) -> DataFrame:
    keys = [F.col(k) for k in ("minute", *KEYS["metric_stats_1m"])]
    return groups.groupBy("day").agg(F.sum(_digest(*keys, F.col("low"), F.col("high"))).alias("extremes"))


def source_facts(table: str, name: str, rows: DataFrame) -> DataFrame:
    """What one silver table says about a rollup, a row a day."""
    given = rows.withColumn("signal", F.lit(SIGNAL_OF[name])).withColumn("minute", _minute("event_time"))
    own, keys = _day(name), [F.col("minute"), *(F.col(k) for k in KEYS[table])]
    sizes = [F.count("*").alias("source_rows"), F.sum("source_hash").alias("source_hash")]
    seen = [own, _digest(*keys).alias("h"), row_hash(rows).cast("decimal(28,0)").alias("source_hash")]
    if table == "metric_stats_1m":
        value = F.col("value")
        facts = given.select(*seen, "value").groupBy("day").agg(
            *_weighted(F.col("h"), F.lit(1).cast("long"), value, value * value),
            F.sum((F.col("h") / float(1 << BITS) + 1) * F.abs(value)).alias("size_value"), *sizes)
        groups = given.groupBy(own, "minute", *KEYS[table]).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        return facts.join(_extremes(groups), "day")
    sums = [F.count("*").alias("rows"), F.sum("h").alias("groups"), *sizes]
    if table == "resource_key_presence_1m":
        # Summed within the row: a second reading of the table for its keys costs more.
        seen.append(F.aggregate(F.map_keys(_R), F.lit(0).cast("long"), lambda acc, key: acc + _digest(*keys, key)).alias("keys"))
        sums.append(F.sum("keys").alias("keys"))
    return given.select(*seen).groupBy("day").agg(*sums)


def rollup_facts(table: str, rows: DataFrame) -> DataFrame:
    """The same of stored rollup rows; ``broken_keys`` counts rows that share their keys with another or lie outside their day."""
    given = rows.withColumn("minute", _minute("window_start"))
    own, keys = _day(table), ["minute", *KEYS[table]]
    h, n = _digest(*(F.col(k) for k in keys)), F.col(COUNT[table])
    alone = given.groupBy(own, *keys).agg(F.count("*").alias("n")).groupBy("day").agg(
        F.sum(F.col("n") - 1).alias("broken_keys"))
    dated = F.count_if(~(F.col("event_date").eqNullSafe(F.to_date("window_start"))
                         & (F.unix_micros("window_start") == F.col("minute") * 60_000_000))).alias("broken_window")
    stored = F.count("*").alias("stored_rows")
    if table == "metric_stats_1m":
        facts = given.groupBy(own).agg(
            *_weighted(h, n, F.col("sum_value"), F.col("sum_squares")), stored, dated)
        bounds = given.select(own, *keys, F.col("min_value").alias("low"), F.col("max_value").alias("high"))
        return facts.join(_extremes(bounds), "day").join(alone, "day")
    facts = given.groupBy(own).agg(F.sum(n).alias("rows"), F.sum(n * h).alias("groups"), stored, dated)
    if table == "resource_key_presence_1m":
        spread = given.select(own, *keys, F.explode("key_counts").alias("key", "c")).groupBy("day").agg(
            F.sum(F.col("c") * _digest(*(F.col(k) for k in keys), F.col("key"))).alias("keys"))
        facts = facts.join(spread, "day", "left")
    return facts.join(alone, "day")


# -- comparison ---------------------------------------------------------------


def collect(facts: DataFrame) -> dict[str, dict]:
    """Facts by day; a few numbers each."""
    return {r["day"]: {k: v or 0 for k, v in r.asDict().items() if k != "day"} for r in facts.collect()}


def added(parts: list[dict[str, dict]]) -> dict[str, dict]:
    """Facts of several sources together."""
    out: dict[str, dict] = {}
    for part in parts:
        for day, facts in part.items():
            own = out.setdefault(day, {})
            for k, v in facts.items():
                own[k] = own.get(k, 0) + v
    return out


def differences(have: dict, wanted: dict) -> list[str]:
    """Names of the facts on which two sides disagree."""
    def near(k: str) -> bool:
        a, b = have.get(k, 0), wanted.get(k, 0)
        if not k.startswith("total_"):
            return a == b
        if not (math.isfinite(a) and math.isfinite(b)):
            return a == b or (math.isnan(a) and math.isnan(b))
        return abs(a - b) <= 1e-9 * max(abs(a), abs(b), wanted.get("size_value", 0) if k == "total_value" else 0)

    names = {*have, *wanted} - {*ONE_SIDED, "size_value"}
    return sorted(k for k in names if not near(k))


def fingerprint(facts: dict) -> int:
    """One number for a day's exact facts; 0 for none."""
    exact = sorted((k, int(v)) for k, v in facts.items() if k not in ONE_SIDED and not k.startswith(("total_", "size_")) and v)
    return int.from_bytes(hashlib.sha256(repr(exact).encode()).digest()[:8], "big") if exact else 0
