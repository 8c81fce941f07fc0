"""Events of one moment: the queries and their check SQL state the same rule."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from telemill import contract as C
from telemill.functions.columns import sig2
from telemill.plans import delivery as D
from telemill.registry.oracle import ORACLE
from telemill.registry.queries import QUERIES
from telemill.sources import bridge

T0 = dt.datetime(2024, 1, 1)
TIED = ["read_scrapes", "rate_by_label", "reject_rate_matrix", "flush_stats", "storage_rates", "delivery_mode",
        "mode_segments_all", "strict_counterfactual", "delivery_verdict", "table_growth"]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Ids 2000 to 2059, later ids at the moment of the one before; two of three tied pairs lose a series to the first."""
    root = str(tmp_path_factory.mktemp("spark-tied"))
    rows = [(2000 + i, T0 + dt.timedelta(seconds=37 * (i - (i % 5 == 4))), 4 * (i // 3),
             ["view", "error"][i // 5 % 2], 1.5, "{}") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{root}/events.parquet")
    return root


def plain(rows):
    return sorted((tuple(float(v) if isinstance(v, int) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
                         for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", TIED)
def test_events_of_one_moment(spark, tied, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet/*.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert plain(QUERIES[name](spark, tied).select(*columns).collect()) == plain(want.fetchall())


def test_a_tied_series_is_that_of_the_last_event_that_has_it(spark, tied):
    got = QUERIES["read_scrapes"](spark, tied).where(
        (F.col("name") == C.METRIC_INGESTED) & (F.col("scrape_ts") == F.lit(T0 + dt.timedelta(seconds=37 * 3))))
    # Events 2003 and 2004 are one scrape; 2004 has no metrics line, so that of 2003 stays.
    assert {r.label_key: r.value for r in got.collect()} == {
        'signal="logs"': 2004 * 3.0, 'signal="trace"': 2004 * 2.0, 'signal="metrics"': 2003 * 5.0}


def test_few_row_groups_are_spread(spark, tied):
    assert bridge.read_events(spark, tied).rdd.getNumPartitions() == 1
    assert bridge.scrape_lines(spark, tied).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_samples_per_tick_need_one_shuffle_of_events(spark, tied):
    plan = D.tick_table(QUERIES["read_scrapes"](spark, tied).withColumn("labels", F.create_map().cast("map<string,string>")))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("x", [125.0, 105.0, 115.0, 12500.0, 12501.0, 99.5, 1350.0, -125.0, 1.25e21])
def test_halves_of_large_numbers_go_to_even(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(sig2("x")).first()[0] == f"{x:.2g}"


def test_half_a_millisecond_goes_to_even(spark):
    row = {"drop_rate": 0.0, "errors_since": 0.0, "export_errors": 0.0, "backpressure_rate": 0.0, "contract_rate": 0.0,
           "ingest_rate": 1.0, "latency_p99": C.LATENCY_CEILING_MS + 2.5 - C.LATENCY_CEILING_MS % 2}
    note = D.delivery_verdict(spark.createDataFrame([row])).first().note
    assert note.startswith(f"slow_export p99_ms={row['latency_p99']:.0f} ")


@pytest.mark.parametrize("later, micros", [(8400, 83), (6380, 79)])
def test_label_rates_are_rounded_by_their_decimals(spark, tmp_path, later, micros):
    # 6800 / 83 us is 81927710.84337349...; a million times that is rounded to a half before it is rounded to a whole.
    rows = [(4999, T0, 0, "view", 1.5, "{}"), (later, T0 + dt.timedelta(microseconds=micros), 0, "view", 1.5, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLE["rate_by_label"])
    columns = [c[0] for c in want.description]
    assert plain(QUERIES["rate_by_label"](spark, str(tmp_path)).select(*columns).collect()) == plain(want.fetchall())
