"""OTLP/JSON export requests (one per line) -> flat signals, one row per record or point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill import contract as C, schemas as S

_ZERO = r"^0*$"


def number_text(d) -> Column:
    """Plain decimal form of a double: 1.0 -> ``1``, 0.5 -> ``0.5``; never an exponent."""
    whole = F.rint(d) == d
    small = F.regexp_replace(d.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    return (
        F.when(F.isnan(d), F.lit("NaN"))
        .when(F.abs(d) == float("inf"), F.when(d > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(whole & (F.abs(d) < 1e18), d.try_cast("bigint").cast("string"))
        .when(whole, F.coalesce(d.try_cast("decimal(38,0)").cast("string"), d.cast("string")))
        .when((F.abs(d) >= 1e-3) & (F.abs(d) < 1e7), d.cast("string"))
        .otherwise(small)
    )


def value_text(v: Column) -> Column:
    """Scalar attribute values as text; arrays, nested maps, bytes and unset become ''."""
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"],
                      number_text(v["doubleValue"]), F.lit(""))


def attrs_to_map(attributes: Column) -> Column:
    """Key/value list -> string map.  Entries without a value vanish, later keys win."""
    entries = F.transform(
        F.filter(attributes, lambda a: a["key"].isNotNull() & a["value"].isNotNull()),
        lambda a: F.struct(a["key"].alias("key"), value_text(a["value"]).alias("value")))
    return F.coalesce(F.map_from_entries(entries),
                      F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


def _u64(c: Column) -> Column:
    """Unsigned 64-bit text as a signed 64-bit integer (wraps, absent is 0)."""
    big = c.try_cast("decimal(20,0)")
    wrapped = F.when(big >= F.lit(str(2**63)).cast("decimal(20,0)"),
                     big - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(big)
    return F.coalesce(wrapped.cast("bigint"), F.lit(0).cast("bigint"))


def _id(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _optional_id(c: Column) -> Column:
    """All-zero and empty ids mean "no id"."""
    return F.when(~_id(c).rlike(_ZERO), _id(c))


def _requests(lines: DataFrame, column: str, ddl: str, field: str) -> DataFrame:
    parsed = lines.select(F.from_json(F.col(column), ddl).alias("req"))
    return parsed.select(F.explode(F.col(f"req.{field}")).alias("r"))


def _base(kind: str, resource: str = "res") -> list[Column]:
    return [
        F.lit(kind).alias("signal_type"),
        F.lit(C.CONTRACT_VERSION).alias("contract_version"),
        F.coalesce(F.try_element_at(F.col(resource), F.lit(C.KEY_SERVICE)),
                   F.lit(C.UNKNOWN_SERVICE)).alias("service_name"),
        F.col(resource).alias("resource_attributes"),
    ]


def _with_resource(requests: DataFrame, scopes: str) -> DataFrame:
    return requests.select(attrs_to_map(F.col("r.resource.attributes")).alias("res"),
                           F.explode(F.col(f"r.{scopes}")).alias("s"))


def flatten_otlp_traces(lines: DataFrame, column: str = "value") -> DataFrame:
    rows = _with_resource(_requests(lines, column, S.OTLP_TRACES_DDL, "resourceSpans"),
                          "scopeSpans").select("res", F.explode("s.spans").alias("x"))
    failed = F.coalesce(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False))
    return rows.select(
        *_base("span"),
        _id(F.col("x.traceId")).alias("trace_id"), _id(F.col("x.spanId")).alias("span_id"),
        _optional_id(F.col("x.parentSpanId")).alias("parent_span_id"),
        F.coalesce(F.col("x.name"), F.lit("")).alias("name"),
        _u64(F.col("x.startTimeUnixNano")).alias("start_unix_nano"),
        _u64(F.col("x.endTimeUnixNano")).alias("end_unix_nano"),
        F.when(failed, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status_code"),
        attrs_to_map(F.col("x.attributes")).alias("attributes"),
    )


def flatten_otlp_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    rows = _with_resource(_requests(lines, column, S.OTLP_LOGS_DDL, "resourceLogs"),
                          "scopeLogs").select("res", F.explode("s.logRecords").alias("x"))
    return rows.select(
        *_base("log"),
        _u64(F.col("x.timeUnixNano")).alias("time_unix_nano"),
        F.coalesce(F.col("x.severityText"), F.lit("")).alias("severity_text"),
        F.coalesce(F.col("x.severityNumber").try_cast("int"), F.lit(0)).alias("severity_number"),
        F.when(F.col("x.body").isNull(), F.lit("")).otherwise(value_text(F.col("x.body")))
        .alias("body"),
        _optional_id(F.col("x.traceId")).alias("trace_id"),
        _optional_id(F.col("x.spanId")).alias("span_id"),
        attrs_to_map(F.col("x.attributes")).alias("attributes"),
    )


def _metrics(lines: DataFrame, column: str) -> DataFrame:
    return _with_resource(_requests(lines, column, S.OTLP_METRICS_DDL, "resourceMetrics"),
                          "scopeMetrics").select("res", F.explode("s.metrics").alias("x"))


def flatten_otlp_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """Gauge and sum points only; a point without a value is dropped."""
    rows = _metrics(lines, column).select(
        "res", F.col("x.name").alias("name"),
        F.when(F.col("x.gauge").isNotNull(), F.lit("gauge"))
        .when(F.col("x.sum").isNotNull(), F.lit("sum")).alias("type"),
        F.explode(F.when(F.col("x.gauge").isNotNull(), F.col("x.gauge.dataPoints"))
                  .otherwise(F.col("x.sum.dataPoints"))).alias("p"))
    value = F.coalesce(F.col("p.asDouble"), F.col("p.asInt").try_cast("bigint").cast("double"))
    return rows.select(
        *_base("metric"),
        _u64(F.col("p.timeUnixNano")).alias("time_unix_nano"),
        F.coalesce(F.col("name"), F.lit("")).alias("name"), "type", value.alias("value"),
        attrs_to_map(F.col("p.attributes")).alias("attributes"),
    ).filter(F.col("value").isNotNull())


def skipped_otlp_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """How many metric messages had a kind this contract version does not carry."""
    return _metrics(lines, column).agg(
        F.count_if(F.col("x.gauge").isNull() & F.col("x.sum").isNull()).alias("skipped_metrics"))
