"""One JSON signal per line -> typed signals, with parse errors kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telemill.functions.columns import computed_once

_STRINGS = ("signal_type", "contract_version", "severity_text", "service_name", "body",
            "trace_id", "span_id", "parent_span_id", "name", "status_code", "type")
_LONGS = ("time_unix_nano", "start_unix_nano", "end_unix_nano")
_SCALARS = ", ".join([*(f"{f} string" for f in _STRINGS), *(f"{f} bigint" for f in _LONGS),
                      "severity_number int", "value double"])
_MAPS = ("attributes", "resource_attributes")

_REQUIRED = {
    "log": ("contract_version", "time_unix_nano", "severity_text", "severity_number",
            "service_name", "body", *_MAPS),
    "span": ("contract_version", "trace_id", "span_id", "name", "service_name",
             "start_unix_nano", "end_unix_nano", "status_code", *_MAPS),
    "metric": ("contract_version", "time_unix_nano", "name", "type", "value", "service_name",
               *_MAPS),
}
_OPTIONAL_STRINGS = {"log": ("trace_id", "span_id"), "span": ("parent_span_id",), "metric": ()}

STATUS_DOMAIN = ("OK", "ERROR")
METRIC_TYPE_DOMAIN = ("gauge", "sum")


def read_signals_ndjson(spark: SparkSession, path, column: str = "value") -> DataFrame:
    """Batch reader: text files under ``path`` -> parsed signals."""
    return parse_signals(spark.read.text(path).withColumnRenamed("value", column), column)


def _kind(field: str) -> Column:
    """JSON type of a top-level field; SQL NULL when absent."""
    return F.col(f"_kind_{field}")


def _all_strings(field: str) -> Column:
    return F.expr(
        f"coalesce(forall(map_values(try_variant_get(_json, '$.{field}', 'map<string,variant>')),"
        " x -> schema_of_variant(x) = 'STRING'), false)")


def _well_typed(field: str) -> Column:
    """Present and of the declared JSON type (a numeric string is not a number)."""
    kind = _kind(field)
    if field in _STRINGS:
        return kind.eqNullSafe("STRING")
    if field in _LONGS or field == "severity_number":
        return kind.eqNullSafe("BIGINT") & F.col(field).isNotNull()
    if field == "value":
        return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))
    return F.col(f"_strings_{field}")


def parse_signals(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse, check types and enumerations.

    Adds ``parse_error``: null for a usable record, otherwise the first reason it could not
    be read (``malformed``, ``signal_type``, ``field:<name>``, ``status_code``, ``type``).
    Blank lines are skipped, bad lines stay as rows so that they can be counted and kept.
    """
    # White space of any kind may follow a record, and a line of nothing else is blank.
    text = F.when(F.regexp_replace(column, r"\s+$", "").endswith("}"), F.col(column))
    raw = computed_once(lines.filter(F.col(column).rlike(r"\S")), _json=F.try_parse_json(text))
    raw = raw.withColumnRenamed(column, "line")
    # Scalars come from the typed reader; types and maps from the parsed record.
    typed = raw.select("*", F.inline(F.array(F.from_json("line", _SCALARS))))
    # Flat columns: with look-ups in a map of kinds the reasons grow beyond what the JVM compiles.
    facts = {
        "_is_object": F.expr("try_variant_get(_json, '$', 'map<string,variant>') is not null"),
        **{f"_kind_{f}": F.expr(f"schema_of_variant(try_variant_get(_json, '$.{f}', 'variant'))")
           for f in (*_STRINGS, *_LONGS, "severity_number", "value")},
        # Lambdas keep a step out of generated code, so they are not among the reasons either.
        **{f"_strings_{f}": _all_strings(f) for f in _MAPS},
    }
    typed = computed_once(
        typed, **facts,
        **{f: F.expr(f"try_variant_get(_json, '$.{f}', 'map<string,string>')") for f in _MAPS})

    reasons = [
        F.when(~F.col("_is_object"), F.lit("malformed")),
        F.when(~F.coalesce(F.col("signal_type").isin(*_REQUIRED), F.lit(False))
               | (_kind("signal_type") != "STRING"), F.lit("signal_type")),
    ]
    for signal, fields in _REQUIRED.items():
        mine = [F.when(~_well_typed(field), F.lit(f"field:{field}")) for field in fields]
        mine += [F.when(_kind(field).isNotNull() & ~_kind(field).isin("STRING", "VOID"), F.lit(f"field:{field}"))
                 for field in _OPTIONAL_STRINGS[signal]]
        reasons.append(F.when(F.col("signal_type") == signal, F.coalesce(*mine)))
    reasons.append(F.when((F.col("signal_type") == "span")
                          & ~F.col("status_code").isin(*STATUS_DOMAIN), F.lit("status_code")))
    reasons.append(F.when((F.col("signal_type") == "metric")
                          & ~F.col("type").isin(*METRIC_TYPE_DOMAIN), F.lit("type")))
    return computed_once(typed, parse_error=F.coalesce(*reasons)).drop("_json", *facts)
