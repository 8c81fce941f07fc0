import datetime as dt

import pytest
from pyspark.sql import Window as W, functions as F

from telemill.functions.series import cut, lagged, newest, running, trailing
from telemill.plans import delivery as D
from telemill.sources.scrapes import read_scrapes

T0 = dt.datetime(2024, 1, 1)
WARM = """# HELP rejected x
rejected{signal="metrics",reason="contract"} 900
rejected{reason="contract",signal="logs"} 40
rejected{signal="trace",reason="backpressure"} 12

errors 3
odd{path="a,b\\"c",le="+Inf"} 1e3 1700000000
bad value
plain +Inf
lat_bucket{le="0.005"} 0
lat_bucket{le="0.01"} 10
lat_bucket{le="0.02"} 50
lat_bucket{le="0.04"} 80
lat_bucket{le="0.08"} 99
lat_bucket{le="+Inf"} 100
"""


def samples(spark, text, instance="c", ts=T0):
    rows = [(instance, ts, i, line) for i, line in enumerate(text.split("\n"))]
    return read_scrapes(spark.createDataFrame(
        rows, "instance string, scrape_ts timestamp, line_no bigint, line string"))


def test_parse(spark):
    got = {(r.name, r.label_key): r.value for r in samples(spark, WARM).collect()}
    assert got[("rejected", 'reason="contract",signal="metrics"')] == 900
    assert got[("errors", "")] == 3
    assert got[("odd", 'le="+Inf",path="a,b\\"c"')] == 1000
    assert got[("plain", "")] == float("inf")
    assert not any(n == "bad" for n, _ in got)
    last = samples(spark, 'x{a="1"} 1\nx{a="1"} 2').collect()
    assert [r.value for r in last] == [2.0]


def test_label_sums_and_absent_family(spark):
    s = samples(spark, WARM)
    assert {r.reason: r.value for r in D.scrape_sum_over(s, "rejected", "reason").collect()} == {
        "contract": 940.0, "backpressure": 12.0}
    pairs = D.scrape_sum_over_pair(s, "rejected", "reason", "signal").collect()
    assert {(r.reason, r.signal): r.value for r in pairs} == {
        ("contract", "metrics"): 900.0, ("contract", "logs"): 40.0, ("backpressure", "trace"): 12.0}
    assert D.scrape_sum_over_pair(s, "errors", "reason", "signal").count() == 0
    assert D.scrape_value(s, "rejected").first().value == 952.0
    assert D.scrape_value(s, "rejected", {"signal": "logs", "reason": "contract"}
                          ).first().value == 40.0
    assert D.scrape_value(s, "nothing").first().value == 0.0


def test_histogram_quantile(spark):
    q = D.histogram_quantile(samples(spark, WARM), "lat", {"p50": .5, "p90": .9, "p99": .99}).first()
    assert 0.01 < q.p50 <= 0.02 and q.p99 > 2 * q.p50
    assert abs(q.p90 - (0.04 + 0.04 * 10 / 19)) < 1e-12
    tail = samples(spark, 'h_bucket{le="0.01"} 1\nh_bucket{le="+Inf"} 100')
    assert D.histogram_quantile(tail, "h", {"p99": .99}).first().p99 == 0.01
    empty = samples(spark, 'h_bucket{le="0.01"} 0\nh_bucket{le="+Inf"} 0')
    assert D.histogram_quantile(empty, "h", {"p": .5}).first().p == 0.0
    assert D.histogram_quantile(tail, "other", {"p": .5}).count() == 0


def test_rate(spark):
    df = spark.createDataFrame([(100., 40., 2.), (5., 233100., 1.), (10., 0., 0.)],
                               "c double, p double, dt double")
    assert [r[0] for r in df.select(D.rate("c", "p", "dt")).collect()] == [30.0, 5.0, 0.0]


def test_rate_by_label_counts_labels_of_either_side(spark):
    a = samples(spark, 'x{s="a"} 10\nx{s="b"} 4', ts=T0)
    b = samples(spark, 'x{s="a"} 30\nx{s="c"} 6', ts=T0 + dt.timedelta(seconds=2))
    got = {r.s: r.rate for r in D.rate_by_label(a.unionByName(b), "x", ["s"]).collect()}
    assert got == {"a": 10.0, "b": 0.0, "c": 3.0}


def _long(spark):
    """One series with a third of the rows, uneven gaps, and chunks of one or two rows."""
    return spark.range(400).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.timestamp_seconds(F.col("id") * F.col("id") * 7).alias("ts"),
        (F.col("id") * 37 % 101).cast("double").alias("v"))


@pytest.mark.parametrize("part_rows", [7, 40, 10_000])
def test_chunked_windows_equal_plain_windows(spark, part_rows):
    df = _long(spark)
    w = W.partitionBy("k").orderBy("ts")
    plain = df.select("k", "ts", F.lag("v").over(w).alias("prev_v"),
                      F.max("v").over(w.rowsBetween(-4, 0)).alias("peak"),
                      F.sum("v").over(w.rowsBetween(-4, 0)).alias("total"))
    got = lagged(df, ["k"], "ts", ["v"], part_rows).select("k", "ts", "prev_v").join(
        trailing(df, ["k"], "ts", 4, {"peak": F.max("v"), "total": F.sum("v")}, part_rows).drop("v"),
        ["k", "ts"])
    assert got.count() == 400 and got.exceptAll(plain).count() == 0
    assert newest(df, ["k"], "ts", 5).groupBy("k").count().filter("count > 5").count() == 0


@pytest.mark.parametrize("part_rows", [7, 40, 10_000])
def test_running_sums_equal_plain_windows(spark, part_rows):
    df = _long(spark).withColumn("k", F.when(F.col("k") != "s3", F.col("k"))).withColumn(
        "ts", F.when(F.col("v") > 50, F.date_trunc("day", "ts")).otherwise(F.col("ts")))
    w = W.partitionBy("k").orderBy("ts", "v").rowsBetween(W.unboundedPreceding, 0)
    plain = df.select("k", "ts", "v", F.sum("v").over(w).alias("s"), F.count("*").over(w).alias("n"))
    got = running(df, ["k"], "ts", {"s": F.col("v"), "n": F.lit(1)}, ("v",), part_rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_one_dense_hour_is_spread(spark):
    """A series with one row a millisecond, all within an hour, goes to many tasks; a sparse one stays whole."""
    dense = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_millis("id").alias("ts"), "id")
    df = dense.unionByName(spark.range(50).select(F.lit("cold").alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), "id"))
    sizes = cut(df, ["k"], "ts", 1000).groupBy("k", "_part").count().collect()
    hot = [r["count"] for r in sizes if r.k == "hot"]
    assert len(hot) == 20 and max(hot) < 1100 and [r["count"] for r in sizes if r.k == "cold"] == [50]
    steps = lagged(df, ["k"], "ts", ["id"], 1000)
    assert steps.filter("k = 'hot' AND prev_id = id - 1").count() == 19_999
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = steps.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    import telemill.functions.series as module
    assert "date_trunc" not in open(module.__file__).read()


def test_runs_across_parts(spark):
    modes = [("a", i, "idle" if i % 100 < 60 else "batch") for i in range(1000)] + [("b", i, "idle") for i in range(300)]
    df = spark.createDataFrame(modes, "instance string, i long, mode string").withColumn("scrape_ts", F.timestamp_seconds("i"))
    got = sorted((r.instance, r.segment, r.mode, r.ticks) for r in D.mode_segments(df, None, 33).collect())
    assert got == [("a", i, ("idle", "batch")[i % 2], (60, 40)[i % 2]) for i in range(20)] + [("b", 0, "idle", 300)]


def test_mode_segments(spark):
    modes = ["idle", "idle", "stream", "batch", "batch", "stream"]
    df = spark.createDataFrame([("c", T0 + dt.timedelta(seconds=i), m)
                                for i, m in enumerate(modes)],
                               "instance string, scrape_ts timestamp, mode string")
    got = D.mode_segments(df).orderBy("segment").collect()
    assert [(r.mode, r.ticks) for r in got] == [("idle", 2), ("stream", 1), ("batch", 2),
                                                ("stream", 1)]
    assert [r.ticks for r in D.mode_segments(df, samples=2).orderBy("segment").collect()] == [1, 1]
