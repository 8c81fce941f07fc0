import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from telemill import contract as C
from telemill.functions.checksum import content_checksum
from telemill.operators import backfill as BF, edges as E, silver as SV
from telemill.plans import rollups as R, views as VW
from telemill.sources import bridge, tables as TB
from telemill.streaming import jobs

SF = "/root/testdata/sf0.001"


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def stored(spark, root, days="2024-01-03"):
    for table, rows in bridge.bronze(spark, SF).items():
        TB.write_piece(rows.filter(F.col(TB.date_column(table)) <= days), root, table, "all")


def test_stream_equals_batch_and_replay_does_not_double(spark, folder):
    lines = bridge.signal_lines(spark, SF).select("value")
    for i in range(2):
        bridge.signal_lines(spark, SF).filter(F.pmod("event_id", F.lit(2)) == i).select(
            "value").coalesce(1).write.text(f"{folder}/parts/{i}")
    os.makedirs(f"{folder}/in")

    def deliver(i):
        name = next(n for n in os.listdir(f"{folder}/parts/{i}") if n.startswith("part-"))
        os.rename(f"{folder}/parts/{i}/{name}", f"{folder}/in/{i}.txt")
        jobs.stream_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp",
                           once=True).awaitTermination()

    deliver(0)
    deliver(1)          # a restart from the checkpoint picks up only the new file
    from telemill.operators import validation as VA
    from telemill.sources import ndjson
    from telemill.operators import mapping
    accepted = VA.apply_policy(VA.validate(ndjson.parse_signals(lines)), "warn")
    base = jobs.stream_silver_base(accepted)
    got = TB.read_silver(spark, f"{folder}/out")
    for t in C.SILVER_TABLES:
        assert content_checksum(got[t]).first() == content_checksum(base[t]).first(), t
    merged = jobs.merge_on_read(spark, f"{folder}/out")
    assert same(merged["volume_1m"], R.volume_1m(base))
    want = R.resource_key_presence_1m(base)
    flat = [*R.VOLUME_KEYS, "rows", F.array_sort(F.map_entries("key_counts")).alias("k")]
    assert same(merged["resource_key_presence_1m"].select(*flat), want.select(*flat))
    assert mapping.to_bronze(accepted)["otel_logs"].count() == TB.read_table(
        spark, f"{folder}/out", "otel_logs").count()

    traces = TB.read_table(spark, f"{folder}/out", "otel_traces")
    assert same(merged["trace_id_ts"], VW.trace_id_ts(traces))

    # The same batch written again under its own id changes nothing.
    before = TB.read_table(spark, f"{folder}/out", "volume_1m").count()
    batch = ndjson.parse_signals(spark.read.text(f"{folder}/in/1.txt"))
    jobs.write_batch(batch, f"{folder}/out", jobs.piece_of(1))
    assert TB.read_table(spark, f"{folder}/out", "volume_1m").count() == before
    bad = spark.read.parquet(f"{folder}/out/{jobs.QUARANTINE}")
    assert bad.count() == VA.validate(ndjson.parse_signals(lines)).filter(
        "parse_error IS NOT NULL OR error_code IS NOT NULL").count()

    # Compaction folds the pieces and keeps what readers see.
    merged = jobs.merge_on_read(spark, f"{folder}/out")
    dates = [str(r.event_date) for r in merged["volume_1m"].select("event_date").distinct()
             .collect()]
    total = merged["volume_1m"].agg(F.sum("rows")).first()[0]
    jobs.compact_rollups(spark, f"{folder}/out", dates, "c1")
    after = TB.read_table(spark, f"{folder}/out", "volume_1m")
    assert after.agg(F.sum("rows")).first()[0] == total
    assert after.groupBy(*R.VOLUME_KEYS).count().filter("count > 1").count() == 0


def test_watermarked_windows(spark, folder):
    from telemill.sources import ndjson
    bridge.signal_lines(spark, SF).select("value").write.text(f"{folder}/in")
    signals = ndjson.parse_signals(spark.readStream.text(f"{folder}/in")).filter(
        "parse_error IS NULL AND coalesce(time_unix_nano, start_unix_nano) > 0")
    q = (jobs.stream_volume_windows(signals, "60 days", "1 day").writeStream.format("memory")
         .queryName("volume_windows").outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    batch = ndjson.parse_signals(spark.read.text(f"{folder}/in")).filter(
        "parse_error IS NULL AND coalesce(time_unix_nano, start_unix_nano) > 0")
    assert spark.table("volume_windows").agg(F.sum("rows")).first()[0] == batch.count()


def test_stream_call_edges(spark, folder):
    ops = bridge.silver(spark, SF)["operation_executions"]
    # Without the hot trace: its repeated ids lie days apart, outside any live watermark.
    plain = ops.groupBy("trace_id", "span_id").count().filter("count = 1").select("trace_id")
    plain = ops.join(plain.distinct(), "trace_id", "left_semi").select(*ops.columns)
    plain.write.parquet(f"{folder}/ops")
    source = spark.readStream.schema(plain.schema).parquet(f"{folder}/ops")
    q = (jobs.stream_call_edges(source, "40 days", "10 days").writeStream.format("memory")
         .queryName("live_edges").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    live = spark.table("live_edges").groupBy("window_start", "src_service", "dst_service").agg(
        F.count("*").alias("spans"), F.count_if("is_error").alias("errors"))
    assert same(live, E.call_edges_1m(spark.read.parquet(f"{folder}/ops")))


def test_edge_refresh_replaces_and_drops_old_dates(spark, folder):
    ops = bridge.silver(spark, SF)["operation_executions"]
    TB.write_piece(ops, folder, "operation_executions", "all")
    jobs.refresh_call_edges(spark, folder, "2024-01-03 12:00:00", 24 * 60)
    jobs.refresh_call_edges(spark, folder, "2024-01-29 12:00:00", 24 * 60)
    got = TB.read_table(spark, folder, "call_edges_1m").drop("event_date")
    want = E.call_edges_1m(ops, dt.datetime(2024, 1, 28, 12))
    assert want.count() > 0 and same(got, want)


def _thirds(ops):
    """Spans dealt so that children and parents, and repeated parents, come in different batches."""
    return [ops.filter(F.pmod(F.xxhash64("span_id", "event_time_ns"), F.lit(3)) == i) for i in range(3)]


def _edges_equal(spark, root, as_of, ops):
    since = dt.datetime.fromisoformat(as_of) - dt.timedelta(days=1)
    got = TB.read_table(spark, root, "call_edges_1m").drop("event_date")
    return same(got, E.call_edges_1m(ops, since))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_edges_by_delta_equal_a_full_computation(spark, folder, order):
    ops = bridge.silver(spark, SF)["operation_executions"]
    parts, landed, times = _thirds(ops), None, ["2024-01-03 09:00:00", "2024-01-03 12:30:30", "2024-01-04 01:00:00"]
    for i, as_of in zip(order, times):
        TB.write_piece(parts[i], folder, "operation_executions", f"b{i}")
        landed = parts[i] if landed is None else landed.unionByName(parts[i])
        how = jobs.refresh_call_edges(spark, folder, as_of)
        assert how == ("full" if i == order[0] else "delta")
        assert _edges_equal(spark, folder, as_of, landed)
    # Nothing new: only spans that leave the window count.
    assert jobs.refresh_call_edges(spark, folder, "2024-01-04 02:00:00") == "delta"
    assert _edges_equal(spark, folder, "2024-01-04 02:00:00", landed)
    days = TB.dates_of(spark, folder, "operation_executions")
    TB.compact(spark, folder, "operation_executions", "c1", days)
    assert jobs.refresh_call_edges(spark, folder, "2024-01-04 03:00:00") == "delta"
    assert _edges_equal(spark, folder, "2024-01-04 03:00:00", landed)
    TB.write_piece(parts[0].withColumn("service_name", F.lit("aaa")), folder, "operation_executions", "odd")
    TB.compact(spark, folder, "operation_executions", "c2", days)
    assert jobs.refresh_call_edges(spark, folder, "2024-01-04 04:00:00") == "full"
    assert _edges_equal(spark, folder, "2024-01-04 04:00:00", landed.unionByName(
        parts[0].withColumn("service_name", F.lit("aaa"))))


def test_delta_groups_only_keys_of_the_batch(spark):
    """A repeated parent with a smaller name moves its children's edges; other spans are not grouped."""
    def span(trace, own, up, service, second, before, after):
        return trace, own, up, service, False, dt.datetime(2024, 1, 1, 0, 0, second), before, after
    ddl = "trace_id string, span_id string, parent_span_id string, service_name string, is_error boolean, event_time timestamp, before boolean, after boolean"
    rows = spark.createDataFrame(
        [span("t", "p", "", "m", 1, True, True), span("t", "c", "p", "x", 2, True, True), span("t", "p", "", "b", 3, False, True),
         span("t", "late", "c", "y", 4, True, True)] + [span(f"u{i}", "p", "", "m", 5, True, True) for i in range(500)], ddl)
    out = E.edge_changes(rows, rows.filter("before <> after"))
    assert {(r.src_service, r.dst_service): r.spans for r in out.collect()} == {("m", "x"): -1, ("b", "x"): 1}


def test_a_plan_made_before_a_swap_reads_the_old_rows_once(spark, folder):
    rows = _logs(spark)
    a, b = rows.filter("severity_number < 13"), rows.filter("severity_number >= 13")
    TB.write_piece(a, folder, "log_events", "p1")
    TB.write_piece(b, folder, "log_events", "p2")
    days = TB.dates_of(spark, folder, "log_events")
    planned = TB.read_table(spark, folder, "log_events")
    changed = rows.withColumn("body", F.lit("new"))
    TB.replace_pieces(TB.stage(changed, folder, "x"), folder, "log_events", "s1", TB.list_pieces(spark, folder, "log_events", days))
    want, now = content_checksum(rows).first(), content_checksum(changed).first()
    assert content_checksum(planned).first() == want
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == now
    assert TB.vacuum(spark, folder, "log_events") == 0          # within the grace time
    assert content_checksum(planned).first() == want
    assert TB.vacuum(spark, folder, "log_events", 0) == 1 and TB.vacuum(spark, folder, "log_events", 0) == 0
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == now
    assert {p for d in days for _, p in TB._stored_pieces(spark, folder, "log_events", [d])} == {"s1"}
    # A reader that listed a record before it was marked still finds it.
    name = TB.swaps(spark, folder, "log_events").names[0]
    TB._record_text.cache_clear()
    assert TB._record_text(spark, f"{folder}/_swaps/log_events/{name.replace('.done.json', '.json')}") == (
        TB._record_text(spark, f"{folder}/_swaps/log_events/{name}"))
    TB.write_piece(a, folder, "log_events", "p1")               # a batch replayed after its files went
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == now


def test_an_unpublished_piece_is_hidden(spark, folder, monkeypatch):
    rows = _logs(spark)
    TB.write_piece(rows, folder, "log_events", "p1")
    days = TB.dates_of(spark, folder, "log_events")
    want = content_checksum(rows).first()

    def die(*_, **__):
        raise RuntimeError("lost driver")
    monkeypatch.setattr(TB, "mark_folded", die)
    with pytest.raises(RuntimeError):
        TB.replace_pieces(rows, folder, "log_events", "s1", [(d, "p1") for d in days])
    monkeypatch.undo()
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == want
    assert {p for _, p in TB.list_pieces(spark, folder, "log_events", days)} == {"p1"}
    TB.replace_pieces(rows, folder, "log_events", "s1", [(d, "p1") for d in days])
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == want
    assert {p for _, p in TB.list_pieces(spark, folder, "log_events", days)} == {"s1"}


def test_a_swap_while_a_reader_lists_is_noticed(spark, folder):
    rows = _logs(spark)
    TB.write_piece(rows, folder, "log_events", "p1")
    days = TB.dates_of(spark, folder, "log_events")
    calls = []

    def look():
        calls.append(1)
        if len(calls) == 1:
            TB.replace_pieces(rows, folder, "log_events", "s1", [(d, "p1") for d in days])
        return TB._stored_pieces(spark, folder, "log_events", days)
    found, state = TB.settled(spark, folder, "log_events", look)
    assert len(calls) == 2 and {(d, "p1") for d in days} == state.hidden()[0] and {p for _, p in found} == {"p1", "s1"}


def test_live_range_is_refused_and_recorded(spark, folder):
    stored(spark, folder)
    with pytest.raises(BF.BackfillRefused):
        BF.backfill_base(spark, folder, "2024-01-01", "2024-01-03", "2024-01-03", "r")
    ledger = BF.read_ledger(spark, folder).collect()
    assert [(r.status, r.partition_id) for r in ledger] == [("refused", "2024-01-03")]
    assert not TB.exists(spark, f"{folder}/log_events")


def test_backfill_phases(spark, folder):
    stored(spark, folder)
    live = SV.log_events(TB.read_table(spark, folder, "otel_logs"))
    TB.write_piece(live, folder, "log_events", "live")
    with pytest.raises(BF.BackfillRefused):           # no finished phase 1 yet
        BF.backfill_rollups(spark, folder, "2024-01-01", "2024-01-02", "2024-01-05", "r0")
    days = BF.backfill_base(spark, folder, "2024-01-01", "2024-01-02", "2024-01-05", "r1")
    assert days == ["2024-01-01", "2024-01-02"]
    logs = TB.read_table(spark, folder, "log_events")
    assert same(logs.groupBy("event_date").count(), TB.read_table(spark, folder, "otel_logs")
                .groupBy(F.col("TimestampDate").alias("event_date")).count())
    BF.backfill_rollups(spark, folder, "2024-01-01", "2024-01-02", "2024-01-05", "r2")
    silver = {t: df.filter("event_date <= '2024-01-02'")
              for t, df in TB.read_silver(spark, folder).items()}
    assert same(TB.read_table(spark, folder, "volume_1m"), R.volume_1m(silver))
    ledger = BF.read_ledger(spark, folder)
    base_days = BF.partitions_present(TB.read_silver(spark, folder), "2024-01-01", "2024-01-31")
    gate = BF.rollup_ready_gate(base_days, ledger).first()
    assert (gate.ready, gate.missing) == (False, "2024-01-03")
    done = base_days.filter("partition_id < '2024-01-03'")
    assert BF.rollup_ready_gate(done, ledger).first().ready


def test_tampered_day_is_not_swapped(spark, folder):
    stored(spark, folder, "2024-01-02")

    def tampered(bronze):
        rows = SV.log_events(bronze["otel_logs"])
        return rows.withColumn("body", F.when(F.col("event_date") == "2024-01-02",
                                              F.lit("changed")).otherwise(F.col("body")))
    with pytest.raises(BF.BackfillFailed):
        BF.backfill_base(spark, folder, "2024-01-01", "2024-01-02", "2024-01-05", "r",
                         builders={"log_events": tampered})
    logs = TB.read_table(spark, folder, "log_events")
    assert [str(r.event_date) for r in logs.select("event_date").distinct().collect()] == [
        "2024-01-01"]
    status = {r.partition_id: r.status for r in BF.read_ledger(spark, folder).filter(
        "status <> 'running'").collect()}
    assert status == {"2024-01-01": "ok", "2024-01-02": "failed"}

    with pytest.raises(BF.BackfillFailed, match="structure"):
        BF.backfill_base(spark, folder, "2024-01-01", "2024-01-02", "2024-01-05", "r3",
                         builders={"log_events": lambda b: SV.log_events(b["otel_logs"]).drop(
                             "body")})


def _logs(spark):
    return SV.log_events(bridge.bronze(spark, SF)["otel_logs"])


def test_compaction_keeps_pieces_that_arrive_meanwhile(spark, folder, monkeypatch):
    rows = _logs(spark)
    a, b, late = (rows.filter(F.pmod(F.xxhash64("trace_id", "event_time_ns"), F.lit(3)) == i)
                  for i in range(3))
    TB.write_piece(a, folder, "log_events", "p1")
    TB.write_piece(b, folder, "log_events", "p2")
    days = TB.dates_of(spark, folder, "log_events")
    write = TB.write_piece

    def and_late(df, root, table, piece):
        write(df, root, table, piece)
        if piece == "c1":
            write(late, root, table, "p3")
    monkeypatch.setattr(TB, "write_piece", and_late)
    TB.compact(spark, folder, "log_events", "c1", days)
    monkeypatch.undo()
    got = TB.read_table(spark, folder, "log_events")
    assert content_checksum(got).first() == content_checksum(rows).first()
    assert {p for _, p in TB.list_pieces(spark, folder, "log_events", days)} <= {"c1", "p3"}
    TB.write_piece(b, folder, "log_events", "p2")          # a batch replayed after the fold
    TB.write_piece(late, folder, "log_events", "p3")       # and one that was not folded
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == (
        content_checksum(rows).first())
    TB.compact(spark, folder, "log_events", "c1", days)    # the same id again folds the rest
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == (
        content_checksum(rows).first())
    assert {p for _, p in TB.list_pieces(spark, folder, "log_events", days)} == {"c1"}


def test_compaction_resumes_from_its_list(spark, folder, monkeypatch):
    rows = _logs(spark)
    early, late = rows.filter("severity_number < 13"), rows.filter("severity_number >= 13")
    TB.write_piece(early, folder, "log_events", "p1")
    days = TB.dates_of(spark, folder, "log_events")

    def die(*_):
        raise RuntimeError("lost driver")
    monkeypatch.setattr(TB, "mark_folded", die)
    with pytest.raises(RuntimeError):
        TB.compact(spark, folder, "log_events", "c1", days)
    monkeypatch.undo()
    TB.write_piece(late, folder, "log_events", "p2")       # lands during the outage
    TB.compact(spark, folder, "log_events", "c1", days)
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == (
        content_checksum(rows).first())


def test_backfill_keeps_late_batches_and_doubles_none(spark, folder, monkeypatch):
    bronze = bridge.bronze(spark, SF)
    logs = bronze["otel_logs"].filter("TimestampDate <= '2024-01-02'")
    early, late = logs.filter("SeverityNumber < 13"), logs.filter("SeverityNumber >= 13")
    TB.write_piece(early, folder, "otel_logs", "s1")
    record = BF._record
    landed = []

    def and_late(s, root, entries):
        if not landed and entries[0]["status"] == "running":
            landed.append(1)      # after the lists were taken
            TB.write_piece(late, folder, "otel_logs", "s2")
            TB.write_piece(SV.log_events(late), folder, "log_events", "s2")
        record(s, root, entries)
    monkeypatch.setattr(BF, "_record", and_late)
    BF.backfill_base(spark, folder, "2024-01-01", "2024-01-02", "2024-01-05", "r1")
    monkeypatch.undo()
    assert landed
    TB.write_piece(SV.log_events(early), folder, "log_events", "s1")   # its model part comes late
    want = content_checksum(SV.log_events(logs)).first()
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == want


def test_expired_dates_are_deleted(spark, folder):
    rows = _logs(spark)
    TB.write_piece(rows, folder, "log_events", "p1")
    days = TB.dates_of(spark, folder, "log_events")
    gone = TB.drop_expired(spark, folder, days[-1], {"log_events": 3})
    left = TB.dates_of(spark, folder, "log_events")
    assert left and len(gone) == len(days) - len(left)
    first = rows.select(F.date_sub(F.lit(days[-1]).cast("date"), 3)).first()[0]
    assert content_checksum(TB.read_table(spark, folder, "log_events")).first() == (
        content_checksum(rows.filter(F.col("event_date") >= F.lit(first))).first())
