"""Rates beyond 10^9 have their last digits as the check SQL rounds them."""

import datetime as dt

import duckdb
import pytest

from telemill.registry.oracle import ORACLE
from telemill.registry.queries import QUERIES

T0 = dt.datetime(2024, 1, 1)


def plain(rows):
    return sorted((tuple(v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["counter_rate", "live_counter_rate"])
def test_large_rates_equal_those_of_the_sql(spark, tmp_path, name):
    # After the reset 2558 * 360000 / 0.100105 s: 9199140902.052845 by its decimals, 9199140902.052847 by the product.
    rows = [(4999, T0, 0, "view", 1.5, "{}"), (7558, T0 + dt.timedelta(microseconds=100105), 0, "view", 1.5, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert plain(QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == plain(want.fetchall())
