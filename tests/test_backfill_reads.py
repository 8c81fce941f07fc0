"""How often, and in what way, a backfill reads what it builds on."""

from pyspark.sql import functions as F

from telemill.operators import proofs as PR
from telemill.registry.queries import QUERIES  # noqa: F401 - the bridge needs its session settings
from telemill.sources import bridge, tables as TB

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listed_pieces_are_read_without_a_join(spark, folder):
    rows = bridge.silver(spark, SF)["log_events"]
    for i in range(3):
        TB.write_piece(rows.filter(F.pmod("event_time_ns", F.lit(3)) == i), folder, "log_events", f"p{i}")
    listed = TB.list_pieces(spark, folder, "log_events", TB.dates_of(spark, folder, "log_events"))
    wanted = [(day, piece) for day, piece in listed if piece != "p1"][1:]
    got = TB.read_pieces(spark, folder, "log_events", wanted, keep_piece=True)
    assert "Join" not in executed(got) and "Exchange" not in executed(got)
    seen = {(str(r.event_date), r.piece) for r in got.select("event_date", "piece").distinct().collect()}
    assert seen == set(wanted)
    assert got.count() == sum(rows.filter((F.col("event_date") == day) & (
        F.pmod("event_time_ns", F.lit(3)) == int(piece[1:]))).count() for day, piece in wanted)


def test_a_source_of_counts_and_keys_is_read_once(spark, folder):
    rows = TB.stage(bridge.silver(spark, SF)["log_events"], folder, "rows")
    for table, scans in (("volume_1m", 1), ("resource_key_presence_1m", 1)):
        assert executed(PR.source_facts(table, "log_events", rows)).count("Scan parquet") == scans
    facts = PR.collect(PR.source_facts("resource_key_presence_1m", "log_events", rows))
    keys = rows.select(F.col("event_date").cast("string").alias("day"), PR._minute("event_time").alias("minute"), "service_name",
                       F.lit("log").alias("signal"), F.explode(F.map_keys("resource_attributes")).alias("key"))
    plain = keys.groupBy("day").agg(F.sum(PR._digest(F.col("minute"), F.col("service_name"), F.col("signal"), F.col("key"))))
    assert {d: own["keys"] for d, own in facts.items()} == {r[0]: r[1] for r in plain.collect()}
