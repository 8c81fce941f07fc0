"""Literal cases of the volume verdict and the delivery rules."""

import pytest
from pyspark.sql import functions as F

from telemill import contract as C
from telemill.functions import verdicts as V
from telemill.functions.columns import sig2
from telemill.plans import boards as B, delivery as D

DDL = ("service string, median double, mad double, sd double, seen bigint, estate bigint,"
       "latest bigint, latest_t bigint, series array<struct<t:bigint,n:bigint>>")


def band(spark, *, median=100.0, mad=10.0, sd=20.0, seen=30, estate=30, latest=100, series=None):
    series = series if series is not None else [(i, 100) for i in range(30)]
    return spark.createDataFrame(
        [("svc", median, mad, sd, seen, estate, latest, 0, series)], DDL)


def verdict(spark, **row):
    return V.volume_state(band(spark, **row)).first()


def test_band_is_the_rule(spark):
    v = verdict(spark)
    assert (v.lo, v.hi) == (round(100 - 3 * 14.826, 1), round(100 + 3 * 14.826, 1))
    assert verdict(spark, latest=int(v.hi) + 2).state != "passing"
    assert verdict(spark, latest=int(v.hi) - 2).state == "passing"
    assert verdict(spark, latest=100 + 75).state == "fail"


def test_flat_series(spark):
    flat = verdict(spark, mad=0.0, sd=0.0, latest=10**6)
    assert (flat.state, flat.estimator, flat.why) == ("unmonitored", "none", V.NO_DISPERSION)
    fallback = verdict(spark, mad=0.0, sd=20.0)
    assert (fallback.estimator, fallback.state) == ("stddev", "passing")


def test_short_window_and_absence(spark):
    short = verdict(spark, seen=3, estate=3, latest=99999)
    assert short.state == "unmonitored" and short.why == "too_few_buckets n=3"
    gone = verdict(spark, seen=18, estate=30)
    assert (gone.state, gone.absent) == ("passing", 12)


def test_estimator_has_to_fit_its_window(spark):
    partial = [600, 750, 1000, 1250, 1300, 1600, 1900, 2000, 2200, 2400, 2600]
    series = [(i, 2850) for i in range(20)] + [(20 + i, n) for i, n in enumerate(partial)]
    v = verdict(spark, median=2800.0, mad=50.0, sd=699.0, seen=31, estate=31, latest=1600,
                series=series)
    assert v.estimator == "stddev" and v.oob <= 0.15 and v.state == "passing"
    modes = [(i, 100) for i in range(15)] + [(15 + i, 10_000) for i in range(15)]
    v = verdict(spark, mad=0.5, sd=1.0, latest=10_000, series=modes)
    assert v.state == "unmonitored" and v.why == V.NO_BAND


def test_volume_band_uses_element_floor_half(spark):
    rows = [("a", f"2024-01-01 00:0{i}:00", n) for i, n in enumerate([1, 2, 3, 4])]
    rows += [("b", "2024-01-01 00:09:00", 7)]
    buckets = spark.createDataFrame(rows, "service string, t string, n bigint").withColumn(
        "t", F.col("t").cast("timestamp"))
    out = {r.service: r for r in B.volume_band(buckets, None).collect()}
    assert (out["a"].median, out["a"].mad, out["a"].latest) == (3.0, 1.0, 4)
    assert out["a"].estate == out["b"].estate == 5 and out["b"].seen == 1
    assert [(p.t % 600 // 60, p.n) for p in out["a"].series] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_producer_health_takes_the_worst(spark):
    v = V.volume_state(band(spark, seen=18, estate=30))
    c = spark.createDataFrame([("other", 5, "a,b")],
                              "service string, violating bigint, missing_keys string")
    out = {r.service: r for r in B.producer_health(v, c).collect()}
    assert (out["svc"].state, out["svc"].why) == ("warn", "silent buckets=12/30")
    assert (out["other"].state, out["other"].why) == ("warn", "keys_missing rows=5 keys=2/5")


@pytest.mark.parametrize("x", [0.0, 0.5, 1.25, 1.15, 1.35, 1.45, 9.96, 3.0, 12.5, 10.5, 99.4, 100.0,
                               123.0, 0.05, 0.01, 7.0, 2500.0])
def test_two_significant_digits(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(sig2("x")).first()[0] == f"{x:.2g}"


METRICS = {"instance": "c", "drop_rate": 0.0, "errors_since": 0.0, "export_errors": 0.0,
           "backpressure_rate": 0.0, "contract_rate": 0.0, "latency_p99": 0.0,
           "ingest_rate": 500.0, "collector_up": True, "store_up": True}


def state(spark, policy="warn", **over):
    row = {**METRICS, **over}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    r = D.delivery_verdict(df, policy).first()
    return r.state, r.note


def test_delivery_rules_in_order(spark):
    assert state(spark) == ("ok", "healthy")
    assert state(spark, collector_up=False, drop_rate=1.0) == ("fail", "collector_down")
    assert state(spark, store_up=False)[0] == "fail"
    assert state(spark, drop_rate=0.5, export_errors=3.0) == (
        "fail", "lost per_s=0.5 batches=3")
    assert "pushed_back" in state(spark, backpressure_rate=1.0, contract_rate=9.0)[1]
    assert state(spark, contract_rate=3.0) == ("warn", "off_contract per_s=3 action=exported")
    assert state(spark, "strict", contract_rate=3.0)[1].endswith("discarded")
    assert state(spark, latency_p99=120.0) == ("warn", "slow_export p99_ms=120 limit_ms=80")
    assert state(spark, ingest_rate=0.0) == ("idle", "nothing_arrived")


def test_delivery_mode_thresholds(spark):
    rows = [("stream", 988.0, 0.99, 0.99, 1000.0), ("batch", 16297.0, 5.9, 6.6, 2500.0),
            ("batch", 16000.0, 1.0, 1.0, 2500.0), ("idle", 0.0, 0.0, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "want string, ingest_rate double, flush_rate double,"
                                     "flush_peak double, records_per_flush double")
    assert all(r.want == r.mode for r in D.delivery_mode(df).collect())


def test_strict_counterfactual_never_reports_a_false_zero(spark):
    df = spark.createDataFrame([("c", 1, 0.0, 0.0), ("c", 2, 10.0, 0.0), ("c", 3, 10.0, 2.0)],
                               "instance string, scrape_ts int, ingest_rate double,"
                               "contract_rate double")

    def outcomes(policy):
        rows = D.strict_counterfactual(df, policy).orderBy("scrape_ts").collect()
        return [r.outcome for r in rows], rows[2].share_of_throughput
    assert outcomes("warn") == (["no traffic", "clean", "would be dropped"], 0.2)
    assert outcomes("off") == (["not measured"] * 3, None)
    assert outcomes("unknown")[0] == ["policy unknown"] * 3


def test_coverage_gate_and_fallback(spark):
    cov = spark.sql("SELECT t AS tbl, timestamp'2024-01-01' AS oldest FROM VALUES "
                    "('operation_executions'), ('log_events'), ('metric_observations') v(t)")
    assert B.choose_source(cov, C.SILVER_TABLES, 60, "2024-01-01 02:00:00") == "rollup"
    assert B.choose_source(cov, C.SILVER_TABLES, 180, "2024-01-01 02:00:00") == "raw"
    assert B.choose_source(cov.limit(0), C.SILVER_TABLES, 60, "2024-01-01 02:00:00") == "raw"
    assert B.choose_source(cov, C.SILVER_TABLES[:1], 25 * 60, "2024-02-01", 24 * 60) == "raw"
    reads = spark.sql("SELECT timestamp'2024-03-01' + make_dt_interval(id) AS read_at,"
                      " timestamp'2024-01-01' AS oldest FROM range(7)")
    assert B.fallback_removal_ready(reads, "2024-03-08").first().ready
    assert not B.fallback_removal_ready(reads.limit(6), "2024-03-08").first().ready
    young = reads.unionByName(spark.sql(
        "SELECT timestamp'2024-03-09' AS read_at, timestamp'2024-03-05' AS oldest"))
    assert not B.fallback_removal_ready(young, "2024-03-10").first().ready
