import random

from pyspark.sql import functions as F

from telemill import contract as C
from telemill.functions.quantiles import exact_quantiles
from telemill.operators import edges as E, graph as G, quality as Q, traces as TR
from telemill.plans import boards as B, rollups as R, views as VW
from telemill.sources import bridge, topology

SF = "/root/testdata/sf0.001"


def test_exact_quantiles_match_sorting_with_a_hot_group(spark):
    rng = random.Random(7)
    groups = {f"g{i}": [rng.choice([rng.randrange(50), rng.randrange(10**12),
                                    -rng.randrange(10**6)]) for _ in range(rng.randrange(1, 40))]
              for i in range(20)}
    groups["hot"] = [rng.randrange(10**9) for _ in range(3000)] + [5] * 3000
    rows = [(k, v, v % 2 == 0) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v bigint, even boolean")
    out = {r.k: r for r in exact_quantiles(
        df, ["k"], "v", {"p50": (50, 100), "p95": (95, 100), "p99": (99, 100)},
        count="n", maximum="hi", flags={"evens": F.col("even")}).collect()}
    for k, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert (out[k].n, out[k].hi, out[k].evens) == (n, s[-1], sum(v % 2 == 0 for v in vs))
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert out[k][name] == s[min(n * p // 100, n - 1)], (k, name)


def test_quantile_definition(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v bigint").withColumn(
        "k", F.lit(None).cast("string"))
    assert exact_quantiles(df, ["k"], "v", {"m": (1, 2)}).first().m == 3


def ops(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string,"
                                       "service_name string, is_error boolean").select(
        "*", F.lit("2024-01-01 00:00:30").cast("timestamp").alias("event_time"),
        F.lit("2024-01-01").cast("date").alias("event_date"))


def test_repeated_parents_do_not_multiply_children(spark):
    rows = [("t", "p", "", "a", False)] * 50 + [("t", "c", "p", "b", True)] * 3
    rows += [("u", "x", "p", "b", False), ("t", "d", "c", "b", False)]
    got = {(r.src_service, r.dst_service): (r.spans, r.errors)
           for r in E.call_edges_1m(ops(spark, rows)).collect()}
    assert got == {("a", "b"): (3, 3), ("b", "b"): (1, 0)}
    assert E.call_edges_1m(ops(spark, rows), "2024-01-02").count() == 0


def test_edge_boards(spark):
    observed = spark.createDataFrame(
        [("web-intake", "event-bus", 100, 1), ("partner-intake", "event-bus", 200, 10),
         ("x", "y", 5, 0)], "src string, dst string, spans bigint, errors bigint")
    nodes, edges = topology.read_topology(spark, bridge.declared(spark))
    assert nodes.count() == 7 and edges.count() == 7
    health = {(r.src, r.dst): r for r in G.edge_health(observed, edges).collect()}
    assert len(health) == 7
    a = health[("web-intake", "event-bus")]
    assert (a["class"], a.share_of_peak) == ("warn", 0.5)
    assert health[("partner-intake", "event-bus")]["class"] == "fail"
    assert health[("lake-writer", "report-server")]["class"] == "declared-only"
    assert [tuple(r)[:2] for r in G.undeclared_edges(observed, edges).collect()] == [("x", "y")]
    status = G.declared_vs_observed_edges(observed, edges).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in status} == {"both": 2, "declared-only": 5,
                                                      "observed-only": 1}


def test_topology_from_files(spark, folder):
    rows = [("a", "k", "sa", ["ghost"], 1.0, 1.0, 0.0), ("b", "k", "sb", ["a"], 1.0, 1.0, 0.0),
            ("c", "k", "sc", None, 1.0, 1.0, 0.0)]
    declared = spark.createDataFrame(rows, topology.DDL)
    declared.write.json(f"{folder}/declared")
    declared.write.parquet(f"{folder}/declared.parquet")
    for path in (f"{folder}/declared", f"{folder}/declared.parquet"):
        nodes, edges = topology.read_topology(spark, path)
        assert [(r.src_service, r.dst_service) for r in edges.collect()] == [("sa", "sb")]
        assert {r.component: r.is_root for r in nodes.collect()} == {
            "a": False, "b": False, "c": True}


def test_direct_and_merged_rollups_agree(spark):
    silver = bridge.silver(spark, SF)
    mets = silver["metric_observations"]
    halves = [mets.filter(F.pmod("event_time_ns", F.lit(3)) == i) for i in range(3)]
    parts = R.metric_stats_1m(halves[0]).unionByName(R.metric_stats_1m(halves[1])).unionByName(
        R.metric_stats_1m(halves[2]))
    rounded = [F.round(c, 6).alias(c) for c in ("sum_value", "sum_squares", "avg_value")]
    keys = [*R.METRIC_KEYS, "sample_count", "min_value", "max_value"]
    a = R.metric_rollup_merged(parts).select(*keys, *rounded)
    b = R.metric_rollup_direct(mets).select(*keys, *rounded)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    diff = Q.stddev_reconcile(parts, mets).agg(F.max("difference")).first()[0]
    assert diff < 1e-6


def test_key_presence_counts_rows_without_any_key(spark):
    def table(rows):
        return spark.createDataFrame(rows, "m map<string,string>").select(
            F.lit("2024-01-01 00:00:30").cast("timestamp").alias("event_time"),
            F.lit("s").alias("service_name"), F.col("m").alias("resource_attributes"))
    logs = table([({"a": "1", "b": ""},), ({"a": "2"},), ({},), (None,)])
    silver = {"log_events": logs}
    row = R.resource_key_presence_1m(silver).first()
    assert row.rows == 4 and row.key_counts == {"a": 2, "b": 1}
    only_empty = R.resource_key_presence_1m({"log_events": table([({},)])})
    assert (only_empty.first().rows, only_empty.first().key_counts) == (1, {})
    both = R.resource_key_presence_1m(silver).unionByName(only_empty)
    merged = R.merge_key_presence(both).first()
    assert (merged.rows, merged.key_counts) == (5, {"a": 2, "b": 1})
    missing = {r.key: r.rows_missing_key for r in R.rows_missing_key(both).collect()}
    assert missing == {"a": 3, "b": 4}


def test_contract_violations_count_rows_not_keys(spark):
    full = {k: "x" for k in C.REQUIRED_RESOURCE_KEYS}
    rows = [("ok", full)] * 5 + [("bad", {})] * 2 + [("bad", full)] * 8
    df = spark.createDataFrame(rows, "ServiceName string, ResourceAttributes map<string,string>")
    got = B.contract_violations({"otel_logs": df}).collect()
    assert [(r.service, r.rows, r.violating, r.total_missing) for r in got] == [("bad", 10, 2, 10)]
    share = B.violation_share(B.contract_violations({"otel_logs": df})).first()
    assert (share.share, share.keys_missing) == (0.2, 5)


def test_empty_tables(spark):
    silver = {t: df.limit(0) for t, df in bridge.silver(spark, SF).items()}
    assert B.base_coverage(silver).count() == 0
    assert VW.run_summary(silver).count() == 0
    assert VW.service_health_1m(silver["operation_executions"]).count() == 0
    checks = {r["check"]: r.ok for r in Q.check_base_models(
        spark, bridge.bronze(spark, SF), silver).collect()}
    assert not checks["log_events is not empty"] and not checks["logs conserved"]
    assert checks["no negative duration"]


def test_checks_hold_and_fail_fast(spark):
    silver = bridge.silver(spark, SF)
    volume = R.volume_1m(silver)
    Q.assert_all(Q.check_volume(spark, volume, silver))
    lossy = volume.filter(F.col("service_name") != "lake-writer")
    gone = Q.reconcile_counts(lossy, silver).collect()
    assert {(r.service_name, r.rolled) for r in gone} == {("lake-writer", 0)}
    try:
        Q.assert_all(Q.check_volume(spark, lossy, silver))
    except AssertionError as exc:
        assert "volume agrees for log" in str(exc)
    else:
        raise AssertionError("a lossy rollup passed")


def test_single_trace_detail(spark):
    b = bridge.bronze(spark, SF)
    trace = b["otel_traces"].filter("TimestampNs % 1000 = 500").first().TraceId
    bounds = VW.trace_id_ts(b["otel_traces"]).filter(F.col("TraceId") == trace).first()
    one = TR.trace_detail(b["otel_traces"], b["otel_logs"], trace, bounds.Start, bounds.End)
    many = TR.trace_details(b["otel_traces"], b["otel_logs"], VW.trace_id_ts(
        b["otel_traces"])).filter(F.col("trace_id") == trace)
    assert one.filter("kind = 'span'").count() == 4
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_hot_span_join_is_split_at_run_time(spark):
    """A span with most of the logs: the join partition is split, the result is whole."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        logs = spark.range(0, 20000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
            .alias("trace_id"), F.lit("s").alias("span_id"), F.col("id").alias("event_time_ns"),
            F.lit("svc").alias("service_name"), F.lit("INFO").alias("severity_text"),
            F.md5(F.col("id").cast("string")).alias("body"))
        spans = spark.createDataFrame(
            [("hot", "s", "op", "svc", 1.0, "Ok")] * 5 + [("3", "s", "op3", "svc", 1.0, "Ok")],
            "trace_id string, span_id string, operation_name string, service_name string,"
            "duration_ms double, status_code string")
        out = TR.logs_with_trace(logs, spans)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 20000
        assert out.filter(F.col("operation_name") == "op").count() == 13333
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_equal_times_are_ordered_by_value(spark):
    from telemill.functions.series import lagged

    rows = [("s", "2024-01-01 00:59:59", 3.0), ("s", "2024-01-01 00:59:59", 1.0),
            ("s", "2024-01-01 00:59:59", 2.0), ("s", "2024-01-01 01:00:01", 9.0)]
    for given in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(given, "k string, t string, v double").withColumn(
            "t", F.col("t").cast("timestamp"))
        got = sorted((r.v, r.prev_v) for r in lagged(df, ["k"], "t", ["v"]).collect())
        assert got == [(1.0, None), (2.0, 1.0), (3.0, 2.0), (9.0, 3.0)]


def test_quantiles_read_their_source_once(spark):
    ops = bridge.silver(spark, SF)["operation_executions"]
    health = VW.service_health_1m(ops)
    health.collect()
    plan = health._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
