"""Partials merge to what the direct models give; stitched sources read each day once."""

import pytest
from pyspark.sql import functions as F

from telemill import contract as C
from telemill.operators import edges as E
from telemill.plans import boards as B, partials as P, rollups as R, views as VW
from telemill.sources import bridge, tables as TB
from telemill.streaming import jobs

SF = "/root/testdata/sf0.001"


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def halves(df):
    part = F.pmod(F.xxhash64("event_time_ns", "service_name"), F.lit(2))
    return [df.filter(part == i) for i in (0, 1)]


def both(parts):
    a, b = parts
    return a.unionByName(b)


@pytest.fixture(scope="module")
def silver(spark):
    return {t: df.cache() for t, df in bridge.silver(spark, SF).items()}


def test_log_and_coverage_models_merge(silver):
    logs = halves(silver["log_events"])
    counts, traces = both([P.log_counts_1m(x, "day") for x in logs]), both([P.log_traces_1m(x, "day") for x in logs])
    direct = VW.log_health_1m(silver["log_events"], "day")
    assert same(P.log_health_merged(counts, traces), direct)
    estimate = P.log_health_merged(counts).agg(F.sum("affected_trace_count")).first()[0]
    exact = direct.agg(F.sum("affected_trace_count")).first()[0]
    assert abs(estimate - exact) <= 0.05 * exact + 1
    batches = [dict(zip(silver, part)) for part in zip(*(halves(df) for df in silver.values()))]
    merged = P.telemetry_coverage_merged(both([P.coverage_parts_1m(b, "day") for b in batches]))
    assert same(merged, VW.telemetry_coverage_1m(silver, "day"))


@pytest.mark.parametrize("since", [None, "2024-01-20 10:30:40"])
def test_window_quantiles_are_true_ones(spark, silver, since):
    ops = silver["operation_executions"]
    out = P.service_health_window(both([P.latency_slots_1m(x) for x in halves(ops)]), ops, since)
    first = None if since is None else since[:17] + "00"
    rows = ops if since is None else ops.filter(F.col("event_time") >= F.lit(first).cast("timestamp"))
    by = {}
    for r in rows.select("service_name", "duration_ns", "is_error").collect():
        by.setdefault(r.service_name, []).append((r.duration_ns, r.is_error))
    assert {r.service_name for r in out.collect()} == set(by)
    for r in out.collect():
        own = sorted(x for x, _ in by[r.service_name])
        at = [own[min(len(own) * q // 100, len(own) - 1)] / 1e6 for q in (50, 95, 99)]
        assert ([r.p50, r.p95, r.p99], r.worst, r.ops) == (at, own[-1] / 1e6, len(own))
        assert r.errors == sum(e for _, e in by[r.service_name])


def test_key_sets_answer_presence_and_violations(spark, silver):
    bronze = bridge.bronze(spark, SF)
    sets = R.merge_key_sets(both([R.key_sets_1m(b, "day") for b in
                                  [dict(zip(silver, part)) for part in zip(*(halves(df) for df in silver.values()))]]))
    text = F.to_json("key_counts").alias("key_counts")
    keys = [*R.VOLUME_KEYS, "rows", text]
    assert same(R.key_presence_from_sets(sets).select(*keys), R.resource_key_presence_1m(silver, "day").select(*keys))
    every = sets.select(F.col("event_date").alias("covered_day")).distinct()
    want = B.contract_violations(bronze, limit=None)
    for covered in (every, every.limit(0), every.orderBy("covered_day").limit(2)):
        given = sets.join(covered, F.col("event_date") == F.col("covered_day"), "left_semi")
        assert same(B.contract_violations_stitched(given, bronze, covered, limit=None), want)


def test_stitched_edges_and_volume(spark, silver):
    bronze = bridge.bronze(spark, SF)
    edges = E.call_edges_1m(silver["operation_executions"]).withColumn("event_date", F.to_date("window_start"))
    volume = R.volume_1m(silver, "hour")
    days = volume.select(F.col("event_date").alias("covered_day")).distinct().orderBy("covered_day")
    for covered in (days, days.limit(0), days.limit(3)):
        on = lambda df: df.join(covered, F.col("event_date") == F.col("covered_day"), "left_semi")
        assert same(E.call_edges_stitched(on(edges), bronze["otel_traces"], covered, limit=None),
                    E.call_edges(bronze["otel_traces"], limit=None))
        got = B.volume_buckets_stitched(on(volume), bronze["otel_logs"], covered, "2024-01-20 10:30:00", None, "hour")
        assert same(got, B.volume_buckets(bronze["otel_logs"], "2024-01-20 10:30:00", None, "hour"))


def test_stream_keeps_partials_and_covered_days(spark, folder):
    from telemill.sources import ndjson
    lines = bridge.signal_lines(spark, SF)
    for i in (0, 1):
        jobs.write_batch(ndjson.parse_signals(lines.filter(F.pmod("event_id", F.lit(2)) == i).select("value")), folder,
                         jobs.piece_of(i))
    silver = TB.read_silver(spark, folder)
    merged = jobs.merge_on_read(spark, folder)
    assert same(P.telemetry_coverage_merged(merged["coverage_parts_1m"]), VW.telemetry_coverage_1m(silver))
    assert same(P.log_health_merged(merged["log_counts_1m"], merged["log_traces_1m"]), VW.log_health_1m(silver["log_events"]))
    days = TB.dates_of(spark, folder, "log_events")
    full = {str(r.covered_day) for r in TB.covered_days(spark, folder, "volume_1m", C.SILVER_TABLES).collect()}
    assert set(days) <= full
    # A piece of silver rows whose model part is still to come.
    TB.write_piece(silver["log_events"].filter(F.col("event_date") == days[0]), folder, "log_events", "late")
    TB.compact(spark, folder, "operation_executions", "c1", TB.dates_of(spark, folder, "operation_executions"))
    TB.compact(spark, folder, "volume_1m", "c2", days, R.merge_volume)
    now = {str(r.covered_day) for r in TB.covered_days(spark, folder, "volume_1m", C.SILVER_TABLES).collect()}
    assert now == full - {days[0]}
    jobs.rebuild_partials(spark, folder, [days[0]], "r1")
    silver = TB.read_silver(spark, folder)
    assert same(P.telemetry_coverage_merged(TB.read_table(spark, folder, "coverage_parts_1m")), VW.telemetry_coverage_1m(silver))
