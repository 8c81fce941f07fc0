"""The shared ``events`` table read as telemetry.

Each event becomes a span, a log, a gauge point and one or two sum points, plus one scrape
of a collector instance.  Everything is a row-wise function of the event, so the derived
tables are as large as the input.  One trace in ten rows is the same four ids over and
over: a hot trace with repeated span ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telemill import contract as C
from telemill.functions.columns import computed_once, int_div
from telemill.operators import mapping, silver as SV
from telemill.session import configure
from telemill.sources import topology

# Fixed values of the derivation.
FOREIGN_SERVICE = "third-party-agent"
# What the example producers declare: component, kind, service, upstream components, base
# rate, base latency in ms, error ratio.
DECLARED = (
    ("edge.web", "gateway", "web-intake", (), 40.0, 20.0, 0.004),
    ("edge.partner", "gateway", "partner-intake", (), 8.0, 60.0, 0.012),
    ("bus.events", "queue", "event-bus", ("edge.web", "edge.partner"), 48.0, 5.0, 0.001),
    ("work.clean", "compute", "record-cleaner", ("bus.events",), 45.0, 130.0, 0.015),
    ("work.places", "compute", "place-finder", ("work.clean",), 30.0, 320.0, 0.03),
    ("keep.lake", "storage", "lake-writer", ("work.clean", "work.places"), 18.0, 90.0, 0.006),
    ("show.reports", "serving", "report-server", ("keep.lake",), 6.0, 700.0, 0.02),
)
SERVICES = (*(c[2] for c in DECLARED), FOREIGN_SERVICE)
SCENARIOS = ("baseline", "latency_spike", "error_burst")
COMPONENT_TYPES = ("compute", "storage", "messaging")
LATENCY_BUCKETS = (("0.005", 1), ("0.01", 4), ("0.02", 9), ("0.04", 15), ("0.08", 18),
                   ("0.16", 20), ("+Inf", 21))


#: Events whose texts one task makes and parses: some 25 lines each.
SPREAD_ROWS = 15_000


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over as many tasks as the texts made of them are work for: a file of few row groups has few tasks."""
    tasks = math.ceil(rows.count() / SPREAD_ROWS)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def declared(spark: SparkSession) -> DataFrame:
    """The declaration of the example producers, as a table."""
    return spark.createDataFrame(
        [(n, k, s, list(up), rate, ms, err) for n, k, s, up, rate, ms, err in DECLARED],
        topology.DDL)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _every(n: int) -> Column:
    return F.pmod(F.col("event_id"), F.lit(n)) == 0


def base(events: DataFrame) -> DataFrame:
    """The per-event facts all derived tables share."""
    eid = F.col("event_id")
    k = F.when(F.pmod(eid, F.lit(40)) < 4, F.pmod(eid, F.lit(40))).otherwise(eid)
    return events.select(
        "event_id", "user_id", "event_type", "value", "props", "ts", k.alias("k"),
        (F.unix_micros("ts") * 1000 + F.pmod(eid, F.lit(1000))).alias("ns"),
        _pick(SERVICES, F.pmod("user_id", F.lit(len(SERVICES)))).alias("producer"),
        _pick(SCENARIOS, F.pmod(F.day("ts"), F.lit(3))).alias("scenario"),
        F.date_format("ts", "yyyy-MM-dd").alias("run"),
        _pick(COMPONENT_TYPES, F.pmod("user_id", F.lit(3))).alias("component_type"),
    )


def _span_id(k: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit("s"), k.cast("string"))), 1, 16)


def _trace_id() -> Column:
    return F.md5(int_div("k", 4).cast("string"))


def resource_map() -> Column:
    pairs = [
        (C.KEY_SYNTHETIC, F.when(_every(50), F.lit("false")).otherwise(F.lit("true")), None),
        (C.KEY_SCENARIO, F.col("scenario"), None),
        (C.KEY_RUN_ID, F.col("run"), _every(10)),
        (C.KEY_PROVIDER, F.lit("gcp"), _every(40)),
        (C.KEY_SERVICE, F.col("producer"), _every(101)),
    ]
    entries = [F.when(~gone, F.struct(F.lit(k).alias("key"), v.alias("value"))) if gone is not None
               else F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v, gone in pairs]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def _severity() -> tuple[Column, Column]:
    kind = F.col("event_type")
    number = F.when(kind == "error", 17).when(kind == "signup", 13).otherwise(9)
    text = (F.when(kind == "error", F.lit("ERROR")).when(kind == "signup", F.lit("WARN"))
            .when((kind == "click") & _every(17), F.lit("fatal")).otherwise(F.lit("INFO")))
    return number, text


def _signal(kind: str, **fields: Column) -> list[Column]:
    return [F.lit(kind).alias("signal_type"), F.lit(C.CONTRACT_VERSION).alias("contract_version"),
            F.col("producer").alias("service_name"), resource_map().alias("resource_attributes"),
            *[c.alias(n) for n, c in fields.items()]]


def _component(*extra: tuple[str, Column]) -> Column:
    pairs = [(C.KEY_COMPONENT_NAME, F.col("event_type")),
             (C.KEY_COMPONENT_TYPE, F.col("component_type")), *extra]
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])


def log_signals(b: DataFrame) -> DataFrame:
    number, text = _severity()
    anonymous = _every(6)
    return b.select("event_id", *_signal(
        "log", time_unix_nano=F.col("ns"), severity_text=text, severity_number=number,
        body=F.concat_ws(" ", "event_type", "props"),
        trace_id=F.when(~anonymous, _trace_id()), span_id=F.when(~anonymous, _span_id(F.col("k"))),
        attributes=_component()))


def span_signals(b: DataFrame) -> DataFrame:
    return b.select("event_id", *_signal(
        "span", trace_id=_trace_id(), span_id=_span_id(F.col("k")),
        parent_span_id=F.when(F.pmod("k", F.lit(4)) != 0, _span_id(F.col("k") - 1)),
        name=F.col("event_type"), start_unix_nano=F.col("ns"),
        end_unix_nano=F.col("ns") + F.floor(F.col("value") * 1000000),
        status_code=F.when(F.col("event_type") == "error", F.lit("ERROR"))
        .otherwise(F.lit("OK")),
        attributes=_component()))


def metric_signals(b: DataFrame) -> dict[str, DataFrame]:
    def points(name: str, kind: str, value: Column, unit: str, rows: DataFrame) -> DataFrame:
        return rows.select("event_id", *_signal(
            "metric", time_unix_nano=F.col("ns"), name=F.lit(name), type=F.lit(kind),
            value=value, attributes=_component(("unit", F.lit(unit)))))

    one = F.lit(1.0)
    return {
        "gauge": points("operation.latency_ms", "gauge", F.col("value"), "ms", b),
        "sum": points("operation.request_count", "sum", one, "1", b).unionByName(
            points("operation.error_count", "sum", one, "1",
                   b.filter(F.col("event_type") == "error"))),
    }


def bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = base(spread(read_events(spark, sf_dir), "event_id"))
    metrics = metric_signals(b)
    return {
        "otel_logs": mapping.to_bronze_log(log_signals(b)),
        "otel_traces": mapping.to_bronze_span(span_signals(b)),
        "otel_metrics_gauge": mapping.to_bronze_metric(metrics["gauge"]),
        "otel_metrics_sum": mapping.to_bronze_metric(metrics["sum"]),
    }


def silver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return SV.to_silver(bronze(spark, sf_dir))


# -- raw text forms -----------------------------------------------------------


def signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One NDJSON line per event, of a kind chosen by event id, with every sort of damage."""
    b = base(spread(read_events(spark, sf_dir), "event_id")).withColumn("kind", F.pmod("event_id", F.lit(3)))
    number, text = _severity()
    is_log, is_span, is_metric = (F.col("kind") == i for i in range(3))
    trace = F.when(_every(71), F.upper(F.concat(F.lit("A"), F.substring(_trace_id(), 2, 31)))
                   ).otherwise(_trace_id())
    start = F.when(_every(61), F.lit(-1).cast("bigint")).otherwise(F.col("ns"))
    fields = {
        "signal_type": F.when(_every(53), F.lit("profile")).when(is_log, F.lit("log"))
        .when(is_span, F.lit("span")).otherwise(F.lit("metric")),
        "contract_version": F.when(_every(79), F.lit("1.0")).when(_every(73), F.lit("2.0.0"))
        .otherwise(F.lit(C.CONTRACT_VERSION)),
        "service_name": F.when(_every(67), F.lit("")).otherwise(F.col("producer")),
        "resource_attributes": resource_map(),
        "attributes": _component(),
        "time_unix_nano": F.when(~is_span, start),
        "severity_text": F.when(is_log & ~_every(37), text),
        "severity_number": F.when(is_log, number),
        "body": F.when(is_log, F.concat_ws(" ", "event_type", "props")),
        "trace_id": F.when(is_span, trace),
        "span_id": F.when(is_span, _span_id(F.col("k"))),
        "parent_span_id": F.when(is_span & (F.pmod("k", F.lit(4)) != 0),
                                 _span_id(F.col("k") - 1)),
        "name": F.when(is_metric & _every(41), F.lit("")).when(~is_log, F.col("event_type")),
        "start_unix_nano": F.when(is_span, start),
        "end_unix_nano": F.when(is_span, F.when(_every(59), start - 1).otherwise(
            start + F.floor(F.col("value") * 1000000))),
        "status_code": F.when(is_span, F.when(_every(47), F.lit("UNSET")).otherwise(F.lit("OK"))),
        "type": F.when(is_metric, F.when(_every(43), F.lit("histogram")).otherwise(F.lit("gauge"))),
        "value": F.when(is_metric, F.col("value")),
    }
    text_line = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    line = (F.when(_every(89), F.lit("   ")).when(_every(97), F.substring(text_line, 1, 40))
            .when(_every(83), F.regexp_replace(text_line, '"attributes":\\{',
                                               '"attributes":{"n":1,'))
            .otherwise(text_line))
    return computed_once(b, line_text=line).select("event_id", F.col("line_text").alias("value"))


def _kv(key: str, **value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(*[
        (value[n] if n in value else F.lit(None).cast(t)).alias(n)
        for n, t in (("stringValue", "string"), ("boolValue", "boolean"), ("intValue", "string"),
                     ("doubleValue", "double"))]).alias("value"))


def _otlp_resource() -> Column:
    entries = F.transform(F.map_entries(resource_map()), lambda e: F.struct(
        e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    return F.struct(entries.alias("attributes"))


def _otlp_attributes() -> Column:
    return F.array(
        _kv("text", stringValue=F.col("event_type")),
        _kv("flag", boolValue=F.col("event_type") == "error"),
        _kv("count", intValue=F.col("user_id").cast("string")),
        _kv("ratio", doubleValue=F.col("value")),
        _kv("whole", doubleValue=F.floor(F.col("value")).cast("double")),
        _kv("nothing"))


def _request(b: DataFrame, outer: str, scope: str, records: str, items: Column) -> DataFrame:
    scopes = F.array(F.struct(items.alias(records)))
    body = F.array(F.struct(_otlp_resource().alias("resource"), scopes.alias(scope)))
    return computed_once(b, value_text=F.to_json(F.struct(body.alias(outer)))).select(
        "event_id", F.col("value_text").alias("value"))


def otlp_lines(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """One OTLP/JSON export request per event, with two records in it."""
    b = base(spread(read_events(spark, sf_dir), "event_id"))
    ns, zero16 = F.col("ns"), F.lit("0" * 16)
    if signal == "traces":
        def span(offset: int) -> Column:
            root = F.pmod("k", F.lit(4)) == 0
            return F.struct(
                F.upper(_trace_id()).alias("traceId"),
                _span_id(F.col("k") + offset).alias("spanId"),
                F.when(root, zero16).otherwise(_span_id(F.col("k") - 1)).alias("parentSpanId"),
                F.col("event_type").alias("name"),
                (ns + offset).cast("string").alias("startTimeUnixNano"),
                (ns + offset + F.floor(F.col("value") * 1000000)).cast("string")
                .alias("endTimeUnixNano"),
                F.struct(F.when(F.col("event_type") == "error", 2)
                         .when(F.col("event_type") == "click", 1).otherwise(0).alias("code"))
                .alias("status"),
                _otlp_attributes().alias("attributes"))
        return _request(b, "resourceSpans", "scopeSpans", "spans", F.array(span(0), span(500000)))
    if signal == "logs":
        number, text = _severity()

        def record(offset: int) -> Column:
            anonymous = _every(6)
            return F.struct(
                (ns + offset).cast("string").alias("timeUnixNano"),
                number.alias("severityNumber"), text.alias("severityText"),
                F.when(~_every(9), F.struct(F.col("props").alias("stringValue"))).alias("body"),
                F.when(anonymous, F.lit("0" * 32)).otherwise(_trace_id()).alias("traceId"),
                F.when(anonymous, F.lit("")).otherwise(_span_id(F.col("k"))).alias("spanId"),
                _otlp_attributes().alias("attributes"))
        return _request(b, "resourceLogs", "scopeLogs", "logRecords", F.array(record(0), record(1)))

    def point(as_int: bool) -> Column:
        value = F.col("value")
        return F.struct(
            ns.cast("string").alias("timeUnixNano"),
            F.when(F.lit(not as_int) & ~_every(8), value).alias("asDouble"),
            F.when(F.lit(as_int), F.floor(value).cast("string")).alias("asInt"),
            _otlp_attributes().alias("attributes"))
    points = F.struct(F.array(point(False), point(True)).alias("dataPoints"))
    metric = F.array(F.struct(
        F.col("event_type").alias("name"),
        F.when(F.col("event_type") == "view", points).alias("gauge"),
        F.when(F.col("event_type").isin("click", "error"), points).alias("sum"),
        F.when(F.col("event_type").isin("signup", "purchase"), points).alias("histogram")))
    return _request(b, "resourceMetrics", "scopeMetrics", "metrics", metric)


# -- scrapes ------------------------------------------------------------------


def scrape_series() -> list[tuple[str, str, Column, Column | None]]:
    """(family, labels text, value, condition) of one scrape.  Counters restart at 5000."""
    r = F.pmod("event_id", F.lit(5000))
    slow = F.when(_every(7), F.lit(2)).otherwise(F.lit(0))
    out = [
        (C.METRIC_INGESTED, 'signal="logs"', r * 3, None),
        (C.METRIC_INGESTED, 'signal="trace"', r * 2, None),
        (C.METRIC_INGESTED, 'signal="metrics"', r * 5, ~_every(3)),
        (C.METRIC_ACCEPTED, 'signal="logs"', r * 3, None),
        (C.METRIC_REJECTED, 'signal="metrics",reason="contract"', int_div(r, 10), None),
        (C.METRIC_REJECTED, 'reason="contract",signal="logs"', int_div(r, 25), None),
        (C.METRIC_REJECTED, 'signal="trace",reason="backpressure"', int_div(r, 250), ~_every(4)),
        (C.METRIC_STORAGE, 'outcome="persisted"', r * 9, None),
        (C.METRIC_STORAGE, 'outcome="dropped"', int_div(r, 1000), None),
        (C.METRIC_FLUSH_COUNT, "", r * 300 + F.pmod("user_id", F.lit(7)) * 100, None),
        (C.METRIC_FLUSH_SUM, "", r * 360000, None),
        (C.METRIC_EXPORT_ERRORS, "", int_div(r, 2000), None),
        (f"{C.METRIC_LATENCY}_count", "", r + 10, None),
        (f"{C.METRIC_LATENCY}_sum", "", int_div(r, 40), None),
    ]
    for le, share in LATENCY_BUCKETS:
        count = int_div((r + 10) * _share(share, slow), LATENCY_BUCKETS[-1][1])
        out.append((f"{C.METRIC_LATENCY}_bucket", f'le="{le}"', count, None))
    return out


def _share(share: int, slow: Column) -> Column:
    """A slow tick moves observations out of the middle buckets into the tail."""
    return F.lit(share) - slow if 2 < share < LATENCY_BUCKETS[-1][1] else F.lit(share)


def scrape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposition text, one row per line, with comments, blanks and an unreadable value.

    A scrape is what one collector said at one time.  Events of one collector and time are parts of one scrape, in the
    order of their ids, and its lines are numbered through.  The lines of a scrape lie in one task, so that work per
    scrape needs no further shuffle.
    """
    events = spread(read_events(spark, sf_dir).select(
        F.concat(F.lit("collector-"), F.pmod("user_id", F.lit(4)).cast("string")).alias("instance"),
        F.col("ts").alias("scrape_ts"), "event_id", "user_id"), "instance", "scrape_ts")
    lines = [F.lit("# HELP a counter"), F.lit(""), F.lit("broken_series not_a_number")]
    for name, labels, value, cond in scrape_series():
        text = F.concat(F.lit(f"{name}{{{labels}}} " if labels else f"{name} "),
                        value.cast("string"))
        lines.append(text if cond is None else F.when(cond, text))
    exploded = events.select("instance", "scrape_ts", "event_id", F.posexplode(F.array(*lines)).alias("at", "line"))
    return exploded.filter(F.col("line").isNotNull()).select(
        "instance", "scrape_ts", (F.col("event_id") * len(lines) + F.col("at")).alias("line_no"), "line")
