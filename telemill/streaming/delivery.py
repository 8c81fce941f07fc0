"""Delivery figures of the ingest stream itself.

Every batch leaves one row of deltas, written as a piece of its own: what came in by kind, what broke the contract, what was
kept, and how long it took.  A replayed batch replaces its row, a failed attempt leaves a row of its own.  Counters
as a scrape would show them are running sums over these rows, so the delivery health of ``plans.delivery`` reads a stream
as it reads any scraped collector.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill import contract as C, schemas as S
from telemill.functions.series import PART_ROWS, running
from telemill.operators.validation import Tally
from telemill.sources import tables as TB

TABLE = "stream_ticks"
_LANE = {"log": "logs", "span": "trace", "metric": "metrics"}


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _write(spark: SparkSession, root: str, piece: str, row: dict) -> None:
    names = [f.split()[0] for f in TB._split(S.TICK_DDL[TABLE])]
    rows = spark.createDataFrame([tuple(row.get(n) for n in names)], S.TICK_DDL[TABLE].replace("scrape_ts timestamp", "scrape_ts string"))
    TB.write_piece(rows.withColumn("scrape_ts", F.col("scrape_ts").cast("timestamp")).withColumn(
        "event_date", F.to_date("scrape_ts")), root, TABLE, piece)


def record_batch(spark: SparkSession, root: str, piece: str, stream: str, batch: int, tally: Tally, policy: str,
                 seconds: float) -> None:
    """The row of a batch that was written.  Under ``off`` nothing is checked, so nothing counts as rejected."""
    counts, rejects = tally.counts(), tally.rejects()
    bad = {lane: sum(n for (_, kind), n in rejects.items() if _LANE[kind] == lane) for lane in C.SIGNAL_LANES}
    good = {"logs": counts["logs"], "trace": counts["spans"], "metrics": counts["metrics"]}
    seen = {lane: good[lane] + bad[lane] for lane in C.SIGNAL_LANES}
    kept = sum((good if policy == "strict" else seen).values())
    _write(spark, root, piece, {
        "instance": stream, "scrape_ts": str(_now()), "batch": batch, **seen, "unread": counts["parse_errors"],
        **{f"rejected_{lane}": 0 if policy == "off" else n for lane, n in bad.items()}, "persisted": kept, "failed": 0,
        "seconds": seconds})


def record_failure(spark: SparkSession, root: str, piece: str, stream: str, batch: int, seconds: float) -> None:
    """The row of an attempt that failed; another attempt of the batch leaves it in place."""
    zeros = dict.fromkeys([*C.SIGNAL_LANES, *(f"rejected_{x}" for x in C.SIGNAL_LANES), "unread", "persisted"], 0)
    now = _now()
    _write(spark, root, f"{piece}-failed-{now:%Y%m%d%H%M%S%f}", {
        "instance": stream, "scrape_ts": str(now), "batch": batch, **zeros, "failed": 1, "seconds": seconds})


def stream_ticks(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """A tick table as ``plans.delivery.tick_table`` gives it: cumulative counters after each batch or failed attempt."""
    lanes = C.SIGNAL_LANES
    number = lambda c: F.col(c).cast("double")
    total = lambda prefix: sum((number(f"{prefix}{x}") for x in lanes), F.lit(0.0))
    done = (F.col("failed") == 0).cast("double")
    deltas = {
        "ingested": total(""), "accepted": number("persisted"), "rejected": total("rejected_"), "flushes": done,
        "records": total("") * done, "persisted": number("persisted"), "dropped": F.lit(0.0), "export_errors": number("failed"),
        "lat_count": done, "lat_sum": F.col("seconds") * done}
    for x in lanes:
        deltas |= {f"in_{x}": number(x), f"rj_{x}": number(f"rejected_{x}"), f"contract_{x}": number(f"rejected_{x}"),
                   f"backpressure_{x}": F.lit(0.0)}
    deltas |= {"by_contract": total("rejected_"), "by_backpressure": F.lit(0.0)}
    counted = running(rows, ["instance"], "scrape_ts", {f"_{n}": e for n, e in deltas.items()}, ("batch",), part_rows)
    return counted.select("instance", "scrape_ts", *[F.col(f"_{n}").alias(n) for n in deltas],
                          *[F.lit(None).cast("double").alias(q) for q in ("p50", "p90", "p99")])


def read_stream_ticks(spark: SparkSession, root: str) -> DataFrame:
    return stream_ticks(TB.read_table(spark, root, TABLE))
