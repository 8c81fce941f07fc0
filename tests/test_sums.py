"""Sealed checksums of pieces, and the facts a rebuilt day is compared by."""

import glob

import pytest
from pyspark.sql import Window, functions as F

from telemill.functions.checksum import checksum_by_parts, content_checksum
from telemill.operators import proofs as PR, silver as SV
from telemill.plans import rollups as R
from telemill.registry.queries import QUERIES
from telemill.sources import bridge, sums as SM, tables as TB

SF = "/root/testdata/sf0.001"
TABLE = "log_events"


@pytest.fixture(scope="module")
def bronze(spark):
    rows = bridge.bronze(spark, SF)
    return {t: df.filter(F.col(TB.date_column(t)) <= "2024-01-02").cache() for t, df in rows.items()}


@pytest.fixture(scope="module")
def logs(bronze):
    return SV.log_events(bronze["otel_logs"])


def direct(rows):
    by = content_checksum(rows.withColumn("_day", F.col("event_date").cast("string")), ["_day"], skip=("_day",))
    return {r["_day"]: (r["rows"], r["content_hash"]) for r in by.collect()}


def kept(spark, folder):
    return {r["day"]: (r["rows"], r["content_hash"]) for r in SM.by_day(spark, folder, TABLE).collect()}


def pieces(spark, folder):
    return TB.list_pieces(spark, folder, TABLE, TB.dates_of(spark, folder, TABLE))


def tamper(spark, folder, piece):
    """Other rows under the files of one piece, past the writer."""
    path = glob.glob(f"{folder}/{TABLE}/event_date=*/piece={piece}")[0]
    rows = spark.read.parquet(path)
    spark.createDataFrame(rows.withColumn("body", F.lit("other")).collect(), rows.schema).write.mode("overwrite").parquet(path)
    return path.split("event_date=")[1].split("/")[0]


def test_pieces_are_read_once_and_sums_add_up(spark, folder, logs):
    early, late = logs.filter("severity_number < 13"), logs.filter("severity_number >= 13")
    assert SM.seal(spark, folder, TABLE) == 0 and kept(spark, folder) == {}
    TB.write_piece(early, folder, TABLE, "p1")
    first = len(pieces(spark, folder))
    assert SM.seal(spark, folder, TABLE) == first and kept(spark, folder) == direct(early)
    TB.write_piece(late, folder, TABLE, "p2")
    assert SM.seal(spark, folder, TABLE) == len(pieces(spark, folder)) - first
    assert SM.seal(spark, folder, TABLE) == 0 and kept(spark, folder) == direct(logs)
    SM.compact(spark, folder, TABLE, "c1", TB.dates_of(spark, folder, TABLE))
    assert {p for _, p in pieces(spark, folder)} == {"c1"}
    assert kept(spark, folder) == direct(logs) and SM.altered(spark, folder, TABLE).count() == 0
    # Retention takes a day's sums along.
    TB.drop_expired(spark, folder, "2024-01-02", {TABLE: 0})
    assert kept(spark, folder) == direct(logs.filter("event_date >= '2024-01-02'"))


def test_a_piece_written_again_is_measured_again(spark, folder, logs):
    TB.write_piece(logs, folder, TABLE, "p1")
    SM.seal(spark, folder, TABLE)
    half = logs.withColumn("body", F.lit("again"))
    TB.write_piece(half, folder, TABLE, "p1")
    assert kept(spark, folder) == {}
    assert SM.seal(spark, folder, TABLE) > 0 and kept(spark, folder) == direct(half)


def test_altered_pieces_are_found_and_never_folded(spark, folder, logs):
    TB.write_piece(logs.filter("severity_number < 13"), folder, TABLE, "p1")
    TB.write_piece(logs.filter("severity_number >= 13"), folder, TABLE, "p2")
    SM.seal(spark, folder, TABLE)
    before = pieces(spark, folder)
    day = tamper(spark, folder, "p2")
    assert [(r["day"], r["piece"]) for r in SM.altered(spark, folder, TABLE).collect()] == [(day, "p2")]
    with pytest.raises(SM.SumsDiffer, match=day):
        SM.compact(spark, folder, TABLE, "c1", TB.dates_of(spark, folder, TABLE))
    assert pieces(spark, folder) == before


def off(have, wanted):
    have, wanted = PR.collect(have), PR.collect(wanted)
    return {k for d in {*have, *wanted} for k in PR.differences(have.get(d, {}), wanted.get(d, {}))}


def test_facts_name_the_column_that_is_off(bronze):
    traces = bronze["otel_traces"]
    spans = SV.operation_executions(traces).cache()
    wanted = PR.bronze_facts("otel_traces", traces)
    facts = lambda rows: PR.silver_facts("operation_executions", rows, ("otel_traces",))
    assert off(facts(spans), wanted) == set()
    assert off(facts(spans.withColumn("operation_name", F.lit("x"))), wanted) == {"col_operation_name"}
    assert off(facts(spans.withColumn("scenario", F.lit("x"))), wanted) == {"broken_scenario"}
    assert off(facts(spans.withColumn("end_time", F.col("event_time"))), wanted) == {"broken_end_time"}
    # The same values, at other rows.
    names = spans.select("span_id", F.lead("operation_name", 1, "").over(
        Window.orderBy("event_time_ns", "span_id")).alias("n"))
    moved = spans.join(names, "span_id").withColumn("operation_name", F.col("n")).drop("n")
    assert "col_operation_name" in off(facts(moved), wanted)
    assert {"rows", "col_trace_id"} <= off(facts(spans.filter("pmod(duration_ns, 7) > 0")), wanted)


def test_facts_of_rollups(bronze):
    seen = SV.metric_observations(bronze["otel_metrics_gauge"], bronze["otel_metrics_sum"]).cache()
    stats = R.metric_stats_1m(seen).cache()
    wanted = PR.source_facts("metric_stats_1m", "metric_observations", seen)
    facts = lambda rows: PR.rollup_facts("metric_stats_1m", rows)
    assert off(facts(stats), wanted) == set()
    assert off(facts(stats.withColumn("sum_value", F.col("sum_value") * (1 + 1e-6))), wanted) == {"total_value"}
    assert off(facts(stats.withColumn("max_value", F.col("max_value") + 1)), wanted) == {"extremes"}
    assert "groups" in off(facts(stats.withColumn("scenario", F.concat("scenario", F.lit("x")))), wanted)
    halves = stats.withColumn("sample_count", F.lit(0).cast("long")).union(stats)
    assert "broken_keys" in off(facts(halves), wanted)
    silver = {"metric_observations": seen}
    shown = R.resource_key_presence_1m(silver).cache()
    wanted = PR.source_facts("resource_key_presence_1m", "metric_observations", seen)
    assert off(PR.rollup_facts("resource_key_presence_1m", shown), wanted) == set()
    less = shown.withColumn("key_counts", F.transform_values("key_counts", lambda k, v: v + F.lit(1).cast("long")))
    assert off(PR.rollup_facts("resource_key_presence_1m", less), wanted) == {"keys"}


def test_a_table_is_summed_by_part_and_whole_in_one_pass(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "day string, x int")
    sums = checksum_by_parts(rows, F.col("day"), x=F.col("x").cast("long"))
    assert sums._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    got = {(r._of, r.whole): (r.rows, r.content_hash, r.x) for r in sums.collect()}
    by = {r.day: r for r in content_checksum(rows.withColumn("_by", F.col("day")), ["_by"], skip=("_by",)).withColumnRenamed(
        "_by", "day").collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        **{(day, False): (r.rows, r.content_hash) for day, r in by.items()},
        (None, True): (4, content_checksum(rows).first().content_hash)}
    assert got[None, True][2] == 10 and got["a", False][2] == 3


def test_the_checksum_query_reads_each_table_once(spark):
    df = QUERIES["content_checksum"](spark, "/root/testdata/sf0.001")
    # Spans, logs, gauge points and two kinds of sums: each is hashed once, for its days and the whole table.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 5
