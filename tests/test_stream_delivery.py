"""The stream's own delivery figures: ticks from batches, replays and failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from telemill.operators import validation as VA
from telemill.plans import delivery as D
from telemill.sources import bridge, ndjson, tables as TB
from telemill.streaming import delivery, jobs

SF = "/root/testdata/sf0.001"


def test_stream_counts_itself(spark, folder, monkeypatch):
    lines = bridge.signal_lines(spark, SF).select("value")
    lines.repartition(2).write.text(f"{folder}/in")
    real, failures = jobs.write_batch, []

    def fails_once(*args, **kwargs):
        if not failures:
            failures.append(1)
            raise RuntimeError("storage away")
        return real(*args, **kwargs)
    monkeypatch.setattr(jobs, "write_batch", fails_once)

    def run():
        q = jobs.stream_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp", once=True, max_files=1)
        q.awaitTermination()
    with pytest.raises(Exception):
        run()
    run()               # the same batch again, then the other one
    counts = VA.signal_counts(VA.validate(ndjson.parse_signals(lines))).first()
    ticks = delivery.read_stream_ticks(spark, f"{folder}/out")
    rows = ticks.orderBy("scrape_ts").collect()
    good = counts.logs + counts.spans + counts.metrics
    assert [r.flushes for r in rows] == [0, 1, 2] and [r.export_errors for r in rows] == [1, 1, 1]
    assert rows[-1].ingested == good + counts.validation_errors and rows[-1].rejected == counts.validation_errors
    assert rows[-1].persisted == sum(TB.read_table(spark, f"{folder}/out", t).count() for t in (
        "otel_logs", "otel_traces", "otel_metrics_gauge", "otel_metrics_sum"))
    # The delivery rules read them like any collector's.
    metrics = D.tick_metrics(ticks)
    last = metrics.orderBy(F.desc("scrape_ts")).first()
    assert last.flush_rate > 0 and last.ingest_rate > 0 and last.contract_rate > 0
    assert D.delivery_mode(metrics).count() == 3 and D.delivery_verdict(metrics).filter("state = 'warn'").count() >= 1


def test_a_replayed_batch_counts_once(spark, folder):
    signals = ndjson.parse_signals(bridge.signal_lines(spark, SF).select("value"))
    tally = jobs.write_batch(signals, folder, jobs.piece_of(0))
    for _ in range(2):
        delivery.record_batch(spark, folder, jobs.piece_of(0), "stream", 0, tally, "strict", 1.5)
    row = delivery.read_stream_ticks(spark, folder).collect()
    assert len(row) == 1 and row[0].flushes == 1 and row[0].lat_sum == 1.5
    assert row[0].accepted == row[0].ingested - row[0].rejected
    assert abs((row[0].scrape_ts - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 86400
