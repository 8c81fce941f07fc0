"""What plans read: pruned look-ups and time ranges, buckets counted once, figures taken while writing."""

from pyspark.sql import functions as F

from telemill.operators import search as S, traces as TR, validation as VA
from telemill.plans import boards as B, views as VW
from telemill.sources import bridge, ndjson, tables as TB
from telemill.streaming import jobs

SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_trace_lookup_prunes_dates_at_run_time(spark, folder):
    bronze = bridge.bronze(spark, SF)
    for table in ("otel_traces", "otel_logs"):
        TB.write_piece(bronze[table], folder, table, "p")
    TB.write_piece(VW.trace_id_ts_partials(bronze["otel_traces"]), folder, "trace_id_ts", "p")
    traces, logs = (TB.read_table(spark, folder, t) for t in ("otel_traces", "otel_logs"))
    single = VW.merge_trace_id_ts(TB.read_table(spark, folder, "trace_id_ts")).filter(F.to_date("Start") == F.to_date("End"))
    wanted = single.orderBy("TraceId").first().TraceId
    lookup = single.filter(F.col("TraceId") == wanted)
    out = TR.trace_details(traces, logs, lookup)
    plan = final_plan(out)
    assert plan.count("dynamicpruning") >= 2
    days = {r[0] for r in lookup.select(F.to_date("Start").cast("string")).collect()}
    assert len(TB.dates_of(spark, folder, "otel_traces")) > len(days) == 1
    assert sorted(map(str, out.collect())) == sorted(map(str, TR.trace_details(
        bronze["otel_traces"], bronze["otel_logs"], lookup).collect())) and out.count() > 0


def test_metric_series_reads_only_the_dates_asked_for(spark, folder):
    bronze = bridge.bronze(spark, SF)
    for table in ("otel_metrics_gauge", "otel_metrics_sum"):
        TB.write_piece(bronze[table], folder, table, "p")
    gauge, sums = (TB.read_table(spark, folder, t) for t in ("otel_metrics_gauge", "otel_metrics_sum"))
    out = S.metric_series(gauge, sums, width="hour", since="2024-01-03 00:00:00", until="2024-01-05 12:00:00")
    every = S.metric_series(gauge, sums, width="hour").filter(
        "window_start >= '2024-01-03' AND window_start < '2024-01-05 12:00:00'")
    assert out.count() > 0 and out.exceptAll(every).count() == 0 and every.exceptAll(out).count() == 0
    assert "PartitionFilters: [isnotnull(TimeUnixDate" in out._jdf.queryExecution().executedPlan().toString()


def test_band_counts_its_buckets_once(spark):
    logs = bridge.bronze(spark, SF)["otel_logs"]
    band = B.volume_band(B.volume_buckets(logs, "2024-01-20 10:30:00", None, "hour"), None)
    plan = final_plan(band)
    assert "ReusedExchange" in plan and "Window" not in plan
    by = {}
    for r in B.volume_buckets(logs, "2024-01-20 10:30:00", None, "hour").collect():
        by.setdefault(r.service, []).append(r.n)
    for r in band.collect():
        own = sorted(by[r.service])
        mid = own[len(own) // 2]
        assert (r.median, r.mad) == (mid, sorted(abs(n - mid) for n in own)[len(own) // 2])


def test_counts_are_taken_while_a_batch_is_written(spark, folder):
    signals = ndjson.parse_signals(bridge.signal_lines(spark, SF).select("value"))
    tally = jobs.write_batch(signals, folder, "b1")
    checked = VA.validate(signals)
    assert tally.counts() == VA.signal_counts(checked).first().asDict()
    assert tally.rejects() == {(r.reason, r.signal): r.rejected for r in VA.reject_matrix(checked).collect()}


def test_batch_gate(spark):
    checked = VA.validate(ndjson.parse_signals(bridge.signal_lines(spark, SF)))
    rows = VA.batch_gate(checked, F.floor(F.col("event_id") / 7).cast("long")).collect()
    assert {r.refused for r in rows} == {True, False}
    for r in rows[:5]:
        one = checked.filter(F.floor(F.col("event_id") / 7) == r.batch)
        try:
            counts = VA.strict_batch_gate(one)
            assert not r.refused and counts["logs"] == r.logs
        except VA.BatchRejected:
            assert r.refused
