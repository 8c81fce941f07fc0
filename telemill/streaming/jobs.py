"""Continuous ingest and model upkeep.

One micro-batch is parsed once, stored, projected and pre-aggregated.  Everything a batch
writes goes into its own piece of each table, so a batch that Spark replays after a failure
replaces what it wrote before instead of doubling it.  Rollup partials only cover their
batch: late rows simply add another partial for an old minute, so no watermark is needed
and nothing is lost.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill import contract as C
from telemill.operators import edges, mapping, silver as SV, validation
from telemill.plans import partials, rollups, views
from telemill.sources import ndjson, tables as TB
from telemill.streaming import delivery

QUARANTINE = "quarantine"


def piece_of(batch_id: int, stream: str = "stream") -> str:
    return f"{stream}-{batch_id:012d}"


def write_batch(signals: DataFrame, root: str, piece: str, policy: str = "warn",
                required=C.REQUIRED_RESOURCE_KEYS) -> validation.Tally:
    """Everything one batch of parsed signals causes, as one idempotent piece; returns its counts, taken on the way."""
    spark = signals.sparkSession
    tally = validation.Tally()
    checked = TB.stage(tally.watch(validation.validate(signals, required)), root, f"batch-{piece}")
    bronze = mapping.to_bronze(validation.apply_policy(checked, policy))
    base = SV.to_silver(bronze)
    lookup = {"trace_id_ts": views.trace_id_ts_partials(bronze["otel_traces"])}
    for models in (bronze, base, rollups.all_rollups(base), partials.all_partials(base), lookup):
        for table, rows in models.items():
            TB.write_piece(rows, root, table, piece)
    parse_error = F.col("parse_error") if "parse_error" in checked.columns else F.lit(None)
    # Under ``off`` nothing is checked; only lines that cannot be read are kept aside.
    text = F.col("line") if "line" in checked.columns else F.to_json(F.struct("*"))
    (checked.select(text.alias("line"), F.coalesce(parse_error, "error_code").alias("reason"),
                    parse_error.alias("_unread"), F.lit(piece).alias(TB.PIECE))
     .filter(F.col("reason").isNotNull() & (F.lit(policy != "off") | F.col("_unread").isNotNull()))
     .drop("_unread")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(TB.PIECE).parquet(f"{root}/{QUARANTINE}"))
    TB.unstage(spark, root, f"batch-{piece}")
    return tally


def stream_ingest(spark: SparkSession, source: str, root: str, checkpoint: str, *,
                  policy: str = "warn", interval: str = "1 minute",
                  max_files: int | None = 1000, once: bool = False, stream: str = "stream"):
    """NDJSON files under ``source`` -> bronze, silver and rollup tables under ``root``."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    signals = ndjson.parse_signals(reader.text(source))

    def handle(batch: DataFrame, batch_id: int) -> None:
        begun, piece = time.monotonic(), piece_of(batch_id, stream)
        try:
            tally = write_batch(batch, root, piece, policy)
        except Exception:
            delivery.record_failure(batch.sparkSession, root, piece, stream, batch_id, time.monotonic() - begun)
            raise
        delivery.record_batch(batch.sparkSession, root, piece, stream, batch_id, tally, policy, time.monotonic() - begun)

    writer = signals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(
        processingTime=interval)
    return writer.start()


def stream_silver_base(signals: DataFrame) -> dict[str, DataFrame]:
    """Accepted signals (batch or stream) -> silver projections; stateless on both."""
    return SV.to_silver(mapping.to_bronze(signals))


def merge_on_read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Rollup tables as readers see them: all pieces merged per key."""
    out = {t: merge(TB.read_table(spark, root, t)) for t, merge in {**rollups.MERGERS, **partials.MERGERS}.items()}
    out["trace_id_ts"] = views.merge_trace_id_ts(TB.read_table(spark, root, "trace_id_ts"))
    return out


def compact_rollups(spark: SparkSession, root: str, dates: list[str], compaction_id: str):
    for table, merge in {**rollups.MERGERS, **partials.MERGERS, "trace_id_ts": views.merge_trace_id_partials}.items():
        TB.compact(spark, root, table, compaction_id, dates, merge)


def rebuild_partials(spark: SparkSession, root: str, dates: list[str], rebuild_id: str) -> None:
    """Make the partials of some days anew from the silver rows stored now, after a backfill for example.

    As in a backfill, target pieces are listed before source pieces, so a batch that lands meanwhile is either
    in both lists or keeps its own partials.
    """
    old = {t: TB.list_pieces(spark, root, t, dates) for t in partials.MERGERS}
    listed = {t: TB.list_pieces(spark, root, t, dates) for t in C.SILVER_TABLES}
    silver = {t: TB.read_pieces(spark, root, t, x) for t, x in listed.items()}
    for table, rows in partials.all_partials(silver).items():
        covered = {*old[table], *(x for t in partials.SOURCES[table] for x in listed[t])}
        staged = TB.stage(rows, root, f"{table}-{rebuild_id}")
        TB.replace_pieces(staged, root, table, f"rebuilt-{rebuild_id}", sorted(covered), kind="rebuild")
        TB.unstage(spark, root, f"{table}-{rebuild_id}")


def compact_tables(spark: SparkSession, root: str, dates: list[str], compaction_id: str):
    """Fold the pieces of bronze and silver tables too; their rows stay as they are."""
    for table in (*C.BRONZE_TABLES, *C.SILVER_TABLES):
        TB.compact(spark, root, table, compaction_id, dates)
    compact_rollups(spark, root, dates, compaction_id)


def _seen_pieces(state: TB.Swaps, since: int, seen: set[tuple[str, str]], first_day: str):
    """``seen`` after the swaps from number ``since`` on, or None where one mixed seen rows with others or changed rows.

    A compaction of nothing but seen pieces is seen; one of unseen pieces alone is new.
    """
    made: set[tuple[str, str]] = set()
    for number, record in enumerate(state.records):
        members: dict[str, set] = {}
        for day, piece in record["folded"]:
            if day >= first_day:
                members.setdefault(day, set()).add((day, piece))
        for day, own in members.items():
            into = (day, record["into"])
            if number >= since:
                if record["kind"] != "compact":
                    return None
                # A piece written again under its id holds its earlier rows too.
                if own <= seen and (into in seen or into not in made):
                    seen = (seen - own) | {into}
                elif own & seen or into in seen:
                    return None
            made.add(into)
    return seen


def refresh_call_edges(spark: SparkSession, root: str, as_of,
                       minutes: int = C.EDGE_WINDOW_MINUTES) -> str:
    """Bring the trailing day of edges up to date from what changed since the last refresh; returns how.

    A scheduled job, not a stream trigger: a child and its parent may arrive in different
    batches, in either order.  Spans of pieces not seen before come in, spans older than the window go out, and only
    keys of these are grouped and joined (``delta``); the window itself is read as seven narrow columns and filtered.
    A backfill, a compaction of seen with unseen pieces or an earlier ``as_of`` leads to a full computation (``full``).
    The new edges replace the old ones in one step; what has been seen is part of the same record.
    """
    first = spark.range(1).select((F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))).alias("t")).select(
        F.unix_micros("t").alias("us"), F.to_date("t").cast("string").alias("day")).first()
    table = "operation_executions"
    ours = TB.swaps(spark, root, C.EDGE_TABLE)
    notes = [r["note"] for r in ours.records if r["note"]]
    last, seen = notes[-1] if notes else None, None
    from_day = min(first["day"], last["day"]) if last else first["day"]
    days = [d for d in TB.dates_of(spark, root, table) if d >= from_day]
    listed, ops = TB.settled(spark, root, table, lambda: TB.list_pieces(spark, root, table, days))
    pieces = [x for x in listed if x[0] >= first["day"]]
    if last and last["since"] <= first["us"] and last["minutes"] == minutes:
        seen = _seen_pieces(ops, last["swaps"], {tuple(x) for x in last["seen"]}, last["day"])
    columns = ["trace_id", "span_id", "parent_span_id", "service_name", "is_error", "event_time"]
    since = F.timestamp_micros(F.lit(first["us"]))
    if seen is None:
        how = "full"
        rows = TB.read_pieces(spark, root, table, pieces).select(*columns, "event_date")
        edges_now = edges.call_edges_1m(rows, since)
    else:
        how = "delta"
        known = [x for x in listed if x in seen]
        start = F.timestamp_micros(F.lit(last["since"]))
        old = TB.read_pieces(spark, root, table, known).select(*columns).filter(F.col("event_time") >= start).select(
            "*", F.lit(True).alias("before"), (F.col("event_time") >= since).alias("after"))
        new = TB.read_pieces(spark, root, table, [x for x in pieces if x not in seen]).select(*columns).filter(
            F.col("event_time") >= since).select("*", F.lit(False).alias("before"), F.lit(True).alias("after"))
        rows = old.unionByName(new)
        changes = edges.edge_changes(rows, old.filter(~F.col("after")).unionByName(new))
        current = TB.read_table(spark, root, C.EDGE_TABLE).drop("event_date")
        edges_now = edges.merge_edges(current.unionByName(changes))
    number = len(ours.records)
    staged = TB.stage(edges_now.withColumn("event_date", F.to_date("window_start")), root, f"{C.EDGE_TABLE}-{number}")
    replaced = TB.list_pieces(spark, root, C.EDGE_TABLE, TB.dates_of(spark, root, C.EDGE_TABLE))
    note = {"since": first["us"], "day": first["day"], "minutes": minutes, "swaps": len(ops.records), "how": how,
            "seen": [list(x) for x in pieces]}
    TB.replace_pieces(staged, root, C.EDGE_TABLE, f"edges-{number:08d}", replaced, "refresh", note)
    TB.unstage(spark, root, f"{C.EDGE_TABLE}-{number}")
    TB.vacuum(spark, root, C.EDGE_TABLE)
    return how


def stream_volume_windows(signals: DataFrame, lateness: str = "10 minutes",
                          width: str = "1 minute") -> DataFrame:
    """Bounded-state variant of the volume model: late rows beyond the watermark are lost."""
    ns = F.coalesce("time_unix_nano", "start_unix_nano")
    from telemill.functions.columns import attr, ns_to_timestamp

    rows = signals.select(
        ns_to_timestamp(ns).alias("event_time"),
        attr("resource_attributes", C.KEY_SERVICE).alias("service_name"),
        F.when(F.col("signal_type") == "span", F.lit("trace"))
        .otherwise(F.col("signal_type")).alias("signal"))
    return (rows.withWatermark("event_time", lateness)
            .groupBy(F.window("event_time", width), "service_name", "signal")
            .agg(F.count("*").alias("rows"))
            .select(F.col("window.start").alias("window_start"), "service_name", "signal",
                    "rows"))


def stream_call_edges(operations: DataFrame, lateness: str = "10 minutes",
                      gap: str = "1 hour") -> DataFrame:
    """Child spans matched with their parents on a live stream; state is bounded by ``gap``.

    Emits one row per matched child; counts come from a later aggregate.  Duplicated parents
    inside the watermark are dropped so that a child matches at most one.
    """
    rows = operations.withWatermark("event_time", lateness)
    parents = rows.select(F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span"),
                          F.col("service_name").alias("src_service"),
                          F.col("event_time").alias("p_time")
                          ).dropDuplicatesWithinWatermark(["p_trace", "p_span"])
    children = rows.filter(F.col("parent_span_id") != "").select(
        "trace_id", "parent_span_id", F.col("service_name").alias("dst_service"), "is_error",
        "event_time")
    near = F.expr(f"event_time >= p_time - INTERVAL {gap} AND event_time <= p_time + INTERVAL {gap}")
    return children.join(
        parents, (F.col("trace_id") == F.col("p_trace"))
        & (F.col("parent_span_id") == F.col("p_span")) & near).select(
        F.date_trunc("minute", "event_time").alias("window_start"), "src_service",
        "dst_service", "is_error")
