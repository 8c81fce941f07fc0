import json
import re

import pytest
from pyspark.sql import functions as F

from telemill import contract as C
from telemill.functions.columns import map_text
from telemill.operators import mapping, validation as VA
from telemill.sources import ndjson, otlp, tables as TB

T = 1_700_000_000_000_000_000
RESOURCE = {k: "x" for k in C.REQUIRED_RESOURCE_KEYS} | {C.KEY_SERVICE: "svc"}
COMMON = {"contract_version": "1.0.0", "service_name": "svc", "attributes": {"a": "b"},
          "resource_attributes": RESOURCE}
LOG = {**COMMON, "signal_type": "log", "time_unix_nano": T, "severity_text": "INFO",
       "severity_number": 9, "body": "ok"}
SPAN = {**COMMON, "signal_type": "span", "trace_id": "a" * 32, "span_id": "b" * 16,
        "parent_span_id": None, "name": "op", "start_unix_nano": T,
        "end_unix_nano": T + 250_000_000, "status_code": "OK"}
METRIC = {**COMMON, "signal_type": "metric", "time_unix_nano": T, "name": "m", "type": "gauge",
          "value": 250.0}


def without(record, *keys):
    return {k: v for k, v in record.items() if k not in keys}


def less(key):
    return {**LOG, "resource_attributes": without(RESOURCE, key)}


CASES = [
    (LOG, None, None), (SPAN, None, None), (METRIC, None, None),
    ({**METRIC, "value": 3}, None, None), ({**LOG, "extra": {"x": 1}}, None, None),
    ({**LOG, "trace_id": "NOT HEX"}, None, None), ({**LOG, "time_unix_nano": 0}, None, None),
    ({**SPAN, "end_unix_nano": T}, None, None),
    ({**SPAN, "parent_span_id": "c" * 16}, None, None),
    (without(LOG, "body"), "field:body", None), ({**LOG, "body": None}, "field:body", None),
    ({**LOG, "body": 5}, "field:body", None),
    ({**LOG, "time_unix_nano": "5"}, "field:time_unix_nano", None),
    ({**LOG, "time_unix_nano": 1.5}, "field:time_unix_nano", None),
    ({**LOG, "severity_number": 2**40}, "field:severity_number", None),
    ({**LOG, "attributes": {"a": 1}}, "field:attributes", None),
    ({**LOG, "attributes": []}, "field:attributes", None),
    ({**LOG, "trace_id": 7}, "field:trace_id", None),
    ({**LOG, "signal_type": "profile"}, "signal_type", None),
    (without(LOG, "signal_type"), "signal_type", None),
    ({**SPAN, "status_code": "UNSET"}, "status_code", None),
    ({**METRIC, "type": "histogram"}, "type", None),
    ({**METRIC, "value": "1"}, "field:value", None),
    ({**LOG, "contract_version": "1.0"}, None, VA.INVALID_SEMVER),
    ({**LOG, "contract_version": "1.0.0\n"}, None, VA.INVALID_SEMVER),
    ({**LOG, "contract_version": "1.0.1"}, None, VA.VERSION_MISMATCH),
    ({**LOG, "service_name": ""}, None, VA.EMPTY_SERVICE_NAME),
    ({**LOG, "time_unix_nano": -1}, None, VA.NEGATIVE_TIMESTAMP),
    ({**SPAN, "start_unix_nano": -1}, None, VA.NEGATIVE_TIMESTAMP),
    ({**SPAN, "end_unix_nano": T - 1}, None, VA.INVALID_SPAN_INTERVAL),
    ({**SPAN, "trace_id": "A" * 32}, None, VA.INVALID_TRACE_ID),
    ({**SPAN, "trace_id": "a" * 31}, None, VA.INVALID_TRACE_ID),
    ({**SPAN, "trace_id": "a" * 32 + "\n"}, None, VA.INVALID_TRACE_ID),
    ({**SPAN, "span_id": "b" * 17}, None, VA.INVALID_SPAN_ID),
    ({**SPAN, "parent_span_id": ""}, None, VA.INVALID_SPAN_ID),
    ({**METRIC, "name": ""}, None, VA.EMPTY_METRIC_NAME),
    *[(less(k), None, f"{VA.MISSING_RESOURCE_KEY}:{k}") for k in C.REQUIRED_RESOURCE_KEYS],
    ({**less(C.KEY_RUN_ID), "service_name": ""}, None, VA.EMPTY_SERVICE_NAME),
]


def parse(spark, lines):
    return VA.validate(ndjson.parse_signals(spark.createDataFrame(
        list(enumerate(lines)), "i int, value string")))


def test_every_rule(spark):
    got = parse(spark, [json.dumps(c[0]) for c in CASES]).orderBy("i").collect()
    assert len(got) == len(CASES)
    for row, (record, parse_error, code) in zip(got, CASES):
        assert (row.parse_error, row.error_code) == (parse_error, code), record


def test_bad_and_blank_lines(spark):
    lines = ["", "   ", "{", "[]", "null", "5", "text", json.dumps(LOG), json.dumps(LOG) + " x"]
    got = parse(spark, lines)
    assert [r.parse_error for r in got.orderBy("i").collect()] == ["malformed"] * 5 + [
        None, "malformed"]
    assert VA.signal_counts(got).first().asDict() == {
        "logs": 1, "spans": 0, "metrics": 0, "parse_errors": 6, "validation_errors": 0}


def test_file_reader(spark, folder):
    with open(f"{folder}/a.ndjson", "w") as f:
        f.write("\n".join([json.dumps(LOG), "", json.dumps(SPAN), json.dumps(METRIC)]))
    got = VA.validate(ndjson.read_signals_ndjson(spark, folder))
    assert VA.strict_batch_gate(got) == {"logs": 1, "spans": 1, "metrics": 1, "parse_errors": 0,
                                         "validation_errors": 0}


def test_policies_and_gate(spark):
    got = parse(spark, [json.dumps(r) for r in (LOG, less(C.KEY_RUN_ID), SPAN)])
    assert {p: VA.apply_policy(got, p).count() for p in C.POLICIES} == {
        "off": 3, "warn": 3, "strict": 2}
    assert {p: VA.rejects(got, p).count() for p in C.POLICIES} == {"off": 0, "warn": 1, "strict": 1}
    counts = {r.policy: (r.kept, r.rejected) for r in VA.policy_counts(got).collect()}
    assert counts == {"off": (3, 0), "warn": (3, 1), "strict": (2, 1)}
    assert [tuple(r) for r in VA.reject_matrix(got).collect()] == [
        (VA.MISSING_RESOURCE_KEY, "log", 1)]
    with pytest.raises(VA.BatchRejected):
        VA.strict_batch_gate(got)
    with pytest.raises(ValueError):
        VA.apply_policy(got, "maybe")


def test_bronze_rows(spark):
    records = [{**LOG, "severity_number": 300, "time_unix_nano": T + 1999}, SPAN,
               {**SPAN, "status_code": "ERROR"}, METRIC, {**METRIC, "type": "sum"}]
    out = mapping.to_bronze(parse(spark, [json.dumps(r) for r in records]))
    log = out["otel_logs"].first()
    assert (log.SeverityNumber, log.TraceId, log.SpanId, log.ServiceName) == (0, "", "", "svc")
    assert log.TimestampNs == T + 1999 and log.Timestamp.microsecond == 1
    keys = out["otel_logs"].select(F.map_keys("ResourceAttributes")).first()[0]
    assert keys == sorted([*RESOURCE, C.KEY_CONTRACT_VERSION])
    spans = out["otel_traces"].collect()
    assert {s.StatusCode for s in spans} == {"Ok", "Error"}
    assert spans[0].Duration == 250_000_000 and spans[0].ParentSpanId == ""
    assert out["otel_metrics_gauge"].count() == out["otel_metrics_sum"].count() == 1


def test_column_map(spark):
    got = parse(spark, [json.dumps(SPAN)])
    row = TB.apply_column_map(got, "span", {"name": "op_name", "duration_nano": "d",
                                            "no_such_field": "x"}).first().asDict()
    assert row == {"op_name": "op", "d": 250_000_000}


def attrs(**kv):
    return [{"key": k, "value": v} for k, v in kv.items()]


def lines_of(spark, *requests):
    return spark.createDataFrame([(json.dumps(r),) for r in requests], "value string")


def test_attribute_values(spark):
    kv = attrs(s={"stringValue": "x"}, b={"boolValue": True}, i={"intValue": "42"},
               n={"intValue": 7}, d={"doubleValue": 1.0}, h={"doubleValue": 0.5},
               big={"doubleValue": 1e21}, tiny={"doubleValue": 1.5e-7}, empty={},
               arr={"arrayValue": {"values": []}}, kvl={"kvlistValue": {"values": []}},
               by={"bytesValue": "AQ=="})
    kv += [{"key": "gone"}, {"key": "s", "value": {"stringValue": "last"}}]
    req = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"attributes": kv}]}]}]}
    row = otlp.flatten_otlp_logs(lines_of(spark, req)).first()
    assert row.attributes == {
        "s": "last", "b": "true", "i": "42", "n": "7", "d": "1", "h": "0.5",
        "big": "1000000000000000000000", "tiny": "0.00000015", "empty": "", "arr": "", "kvl": "",
        "by": ""}
    assert (row.service_name, row.body, row.trace_id, row.time_unix_nano, row.severity_number) == (
        C.UNKNOWN_SERVICE, "", None, 0, 0)


def test_otlp_spans(spark):
    def span(**over):
        return {"traceId": "AB" * 16, "spanId": "cd" * 8, "name": "n", "startTimeUnixNano": "5",
                "endTimeUnixNano": "18446744073709551615", **over}
    req = {"resourceSpans": [
        {"resource": {"attributes": attrs(**{C.KEY_SERVICE: {"stringValue": "a"}})},
         "scopeSpans": [{"spans": [span(parentSpanId="0" * 16, status={"code": 1}),
                                   span(parentSpanId="ef" * 8, status={"code": 2})]},
                        {"spans": [span(status={"code": "STATUS_CODE_ERROR"})]}]},
        {"scopeSpans": [{"spans": [span()]}]}]}
    rows = otlp.flatten_otlp_traces(lines_of(spark, req, {})).collect()
    assert [r.status_code for r in rows] == ["OK", "ERROR", "ERROR", "OK"]
    assert [r.parent_span_id for r in rows] == [None, "ef" * 8, None, None]
    assert [r.service_name for r in rows] == ["a", "a", "a", C.UNKNOWN_SERVICE]
    assert rows[0].trace_id == "ab" * 16 and rows[0].end_unix_nano == -1


def test_otlp_metrics(spark):
    points = {"dataPoints": [{"timeUnixNano": "1", "asDouble": 1.5}, {"asInt": "42"}, {}]}
    req = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [
        {"name": "g", "gauge": points}, {"name": "s", "sum": points},
        {"name": "h", "histogram": points}, {"name": "none"}, {"name": "e", "gauge": {}}]}]}]}
    lines = lines_of(spark, req)
    rows = otlp.flatten_otlp_metrics(lines).collect()
    assert [(r.name, r.type, r.value) for r in rows] == [
        ("g", "gauge", 1.5), ("g", "gauge", 42.0), ("s", "sum", 1.5), ("s", "sum", 42.0)]
    assert otlp.skipped_otlp_metrics(lines).first().skipped_metrics == 2


def test_map_text_is_ordered(spark):
    df = spark.sql("SELECT map('b', '2', 'a', '1') AS m")
    assert df.select(map_text("m")).first()[0] == "a=1,b=2"
    assert df.filter(F.col("m").isNotNull()).count() == 1


def test_the_reasons_are_generated_code_that_the_jvm_compiles(spark, capsys):
    parsed = ndjson.parse_signals(spark.createDataFrame([('{"signal_type":"log"}',)], "value string"))
    parsed.explain("codegen")
    text = capsys.readouterr().out
    assert "* Generate inline(array(struct(parse_error" in text or ") Generate inline(array(struct(parse_error" in text
    # The JVM interprets methods of more than 8000 bytes.
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) <= 8000
