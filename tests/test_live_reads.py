"""What the live rates read, and plain labels taken as they are."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from telemill.registry import queries as Q
from telemill.sources import scrapes

T0 = dt.datetime(2024, 1, 1)


def test_live_rates_write_their_samples_once(spark, tmp_path, monkeypatch):
    rows = [(5 * i, T0 + dt.timedelta(seconds=7 * i), 0, "view", 1.5, "{}") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = Q.counter_rate(spark, str(tmp_path)).collect()
    monkeypatch.setattr(Q.TB, "stage", lambda *a: pytest.fail("samples staged before they are streamed"))
    assert sorted(map(tuple, Q.live_counter_rate(spark, str(tmp_path)).collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_plain_labels_need_no_taking_apart(spark):
    texts = ['', 'a="b"', 'a="b",', ' a="b"', 'a ="b"', 'a= "b"', 'a="b"\n', 'a="b\nc"', r'a="b\"c"', r'a="b\\"', 'a="x=\\"y\\""',
             'b="1",a="2"', 'a="b,c=d"', 'a="="', '_x9="é{}"', '9x="b"', 'a="b" ', 'a=""', 'no pairs']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", scrapes._canonical(F.col("t")).alias("a"), scrapes._sorted_pairs(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got) == len(texts)


@pytest.mark.parametrize("x, want", [(0.0, 0.0), (0.4999995, 0.5), (0.4999994, 0.499999), (-0.4999995, -0.5), (1e300, 1e300), (None, None),
                                     (float("inf"), float("inf")), (9199140902.052845, 9199140902.052845 * 1e6 / 1e6)])
def test_rounded_products(spark, x, want):
    assert Q._round_product(spark.createDataFrame([(x,)], "x double"), "x").first()[0] == want
