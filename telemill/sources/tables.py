"""Parquet layout of bronze, silver and rollup tables.

Tables are partitioned by event date.  A table grows by *pieces* (a stream batch, a backfill
run): the piece id is a second partition column, and dynamic partition overwrite makes
writing the same piece again harmless.

Replacing pieces by another one is a *swap*: the new piece is written under a pending mark, which hides it, and one
rename publishes a record that shows it and hides the old pieces in the same moment.  A reader resolves the records
once, when it plans; the files of hidden pieces stay until ``vacuum``, so a reader that planned before a
swap still finds its rows.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill import contract as C, schemas as S
from telemill.operators import mapping

PIECE = "piece"
#: Seconds for which replaced pieces stay readable.
GRACE_SECONDS = 3600
#: Endings of swap records, and of those whose replaced pieces are deleted.
_RECORD, _DONE = ".json", ".done.json"

# Sort keys inside files, so that row-group statistics can prune.
LAYOUT = {
    "otel_logs": ("ServiceName", "TimestampNs"),
    "otel_traces": ("ServiceName", "SpanName", "TimestampNs"),
    "otel_metrics_gauge": ("ServiceName", "MetricName", "TimeUnixNs"),
    "otel_metrics_sum": ("ServiceName", "MetricName", "TimeUnixNs"),
    "operation_executions": ("scenario", "service_name", "component_name", "operation_name",
                             "event_time_ns"),
    "log_events": ("scenario", "service_name", "component_name", "severity_number",
                   "event_time_ns"),
    "metric_observations": ("scenario", "service_name", "metric_name", "component_name",
                            "event_time_ns"),
    "metric_stats_1m": ("window_start", "scenario", "service_name", "metric_name"),
    "volume_1m": ("window_start", "service_name", "signal"),
    "resource_key_presence_1m": ("window_start", "service_name", "signal"),
    "call_edges_1m": ("window_start", "src_service", "dst_service"),
    "trace_id_ts": ("TraceId",),
    "latency_slots_1m": ("window_start", "service_name", "operation_name"),
    "log_counts_1m": ("window_start", "service_name"),
    "log_traces_1m": ("window_start", "service_name"),
    "coverage_parts_1m": ("window_start", "service_name"),
    "key_sets_1m": ("window_start", "service_name", "signal"),
    "stream_ticks": ("instance", "scrape_ts"),
}
# Point look-ups by id profit from a bloom filter in the footers.
_BLOOM = {"otel_logs": "TraceId", "otel_traces": "TraceId",
          "operation_executions": "trace_id", "log_events": "trace_id",
          "trace_id_ts": "TraceId"}


def date_column(table: str) -> str:
    return S.BRONZE_DATE.get(table, "event_date")


def table_ddl(table: str) -> str:
    for source in (S.BRONZE_DDL, S.SILVER_DDL, S.ROLLUP_DDL, S.PARTIAL_DDL, S.LOOKUP_DDL, S.TICK_DDL):
        if table in source:
            return source[table]
    return S.EDGE_DDL


def write_piece(df: DataFrame, root: str, table: str, piece: str) -> None:
    """Write one piece of a table; repeating it replaces it, other pieces stay.

    Days on which the piece has already been folded into another are left out, so a batch
    replayed after a compaction or backfill does not double its rows.  The rebalance hint
    gathers each date into few files and still lets AQE split a date that is much larger
    than the others.
    """
    date = date_column(table)
    folded = folded_days(df.sparkSession, root, table, piece)
    again = _mark_rewrite(df.sparkSession, root, table, piece)
    if folded:
        df = df.filter(~F.col(date).cast("string").isin(folded))
    writer = (
        df.withColumn(PIECE, F.lit(piece))
        .hint("rebalance", F.col(date))
        .sortWithinPartitions(date, *LAYOUT[table])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(date, PIECE)
    )
    if table in _BLOOM:
        writer = writer.option(f"parquet.bloom.filter.enabled#{_BLOOM[table]}", "true")
    writer.parquet(f"{root}/{table}")
    if again:
        _mark_rewrite(df.sparkSession, root, table, piece)


def sums_path(root: str, table: str) -> str:
    return f"{root}/_sums/{table}"


def _mark_rewrite(spark: SparkSession, root: str, table: str, piece: str) -> bool:
    """Note that a stored piece is written again, where checksums are kept; whether it is."""
    if not exists(spark, sums_path(root, table)) or not any(
            p == piece for _, p in _stored_pieces(spark, root, table, dates_of(spark, root, table))):
        return False
    mark, fs = _path(spark, f"{root}/_rewrites/{table}/{uuid.uuid4().hex}-{piece}")
    fs.mkdirs(mark.getParent())
    fs.create(mark, True).close()
    return True


def rewrites(spark: SparkSession, root: str, table: str) -> dict[str, int]:
    """How often pieces were marked as written again."""
    return dict(Counter(n.split("-", 1)[1] for n in _names(spark, f"{root}/_rewrites/{table}") if not n.startswith(".")))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small control file that appears whole, by one rename."""
    target, fs = _path(spark, path)
    draft, _ = _path(spark, f"{target.getParent().toString()}/.{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, target):
        raise OSError(f"could not publish {path}")


@lru_cache(maxsize=4096)
def _record_text(spark: SparkSession, path: str) -> str:
    """Records never change, so each is read once.  One that was marked as cleared meanwhile has another name."""
    target, fs = _path(spark, path)
    if not fs.exists(target) and not path.endswith(_DONE):
        return _record_text(spark, path[:-len(_RECORD)] + _DONE)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@dataclass(frozen=True)
class Swaps:
    """The published swaps of a table at one moment, oldest first."""

    names: tuple[str, ...]
    pending: tuple[str, ...]
    records: tuple[dict, ...]

    def folded(self) -> set[tuple[str, str]]:
        return {tuple(x) for r in self.records for x in r["folded"]}

    def hidden(self) -> tuple[set[tuple[str, str]], set[str]]:
        """Replaced pieces that may still have files, by day, and pieces that nobody has published."""
        kept = {tuple(x) for n, r in zip(self.names, self.records) if not n.endswith(_DONE) for x in r["folded"]}
        return kept, set(self.pending) - {r["into"] for r in self.records}


def swaps(spark: SparkSession, root: str, table: str) -> Swaps:
    names = [n for n in _names(spark, f"{root}/_swaps/{table}") if n.endswith(_RECORD) and not n.startswith(".")]
    pending = [n for n in _names(spark, f"{root}/_pending/{table}") if not n.startswith(".")]
    return Swaps(tuple(names), tuple(pending), tuple(
        json.loads(_record_text(spark, f"{root}/_swaps/{table}/{n}")) for n in names))


def settled(spark: SparkSession, root: str, table: str, look):
    """What ``look`` finds, and the swaps that hold for it: none was published or begun meanwhile."""
    state = swaps(spark, root, table)
    while True:
        found = look()
        now = swaps(spark, root, table)
        if (now.names, now.pending) == (state.names, state.pending):
            return found, state
        state = now


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Explicit schema; an absent table reads as an empty one."""
    ddl = table_ddl(table)
    path = f"{root}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    columns = [f.split()[0] for f in _split(ddl)]
    # Files are listed here, once; every action on the result reads these.
    rows, state = settled(spark, root, table, lambda: spark.read.schema(f"{ddl}, {PIECE} string").parquet(path))
    folded, pending = state.hidden()
    if folded:
        place = F.concat_ws("/", F.col(date_column(table)).cast("string"), F.col(PIECE))
        rows = rows.filter(~place.isin(sorted(f"{day}/{piece}" for day, piece in folded)))
    if pending:
        rows = rows.filter(~F.col(PIECE).isin(sorted(pending)))
    return rows.select(*columns)


def _split(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


def _stored_pieces(spark: SparkSession, root: str, table: str,
                   dates: list[str]) -> list[tuple[str, str]]:
    found = []
    for day in dates:
        names = _names(spark, f"{root}/{table}/{date_column(table)}={day}")
        found += [(day, n[len(PIECE) + 1:]) for n in names if n.startswith(f"{PIECE}=")]
    return sorted(found)


def list_pieces(spark: SparkSession, root: str, table: str,
                dates: list[str]) -> list[tuple[str, str]]:
    """``(date, piece)`` of the pieces that readers see now; names only, no data is read."""
    found, state = settled(spark, root, table, lambda: _stored_pieces(spark, root, table, dates))
    folded, pending = state.hidden()
    return [x for x in found if x not in folded and x[1] not in pending]


def read_pieces(spark: SparkSession, root: str, table: str,
                listed: list[tuple[str, str]], keep_piece: bool = False) -> DataFrame:
    """Exactly the listed pieces; what arrives later is not read."""
    own = f", {PIECE} string" if keep_piece else ""
    if not listed:
        return spark.createDataFrame([], table_ddl(table) + own)
    columns = [f.split()[0] for f in _split(table_ddl(table) + own)]
    rows = spark.read.schema(f"{table_ddl(table)}, {PIECE} string").parquet(f"{root}/{table}")
    # A filter on folder names: only these files are opened, and no row is shuffled to meet a list of names.
    place = F.concat_ws("/", F.col(date_column(table)).cast("string"), F.col(PIECE))
    return rows.filter(place.isin(sorted(f"{day}/{piece}" for day, piece in listed))).select(*columns)


def mark_folded(spark: SparkSession, root: str, table: str, listed: list[tuple[str, str]],
                into: str, kind: str = "compact", note: dict | None = None) -> None:
    """Publish that ``into`` stands for the listed pieces from now on."""
    folder = f"{root}/_swaps/{table}"
    _path(spark, folder)[1].mkdirs(_path(spark, folder)[0])
    record = {"into": into, "kind": kind, "note": note,
              "folded": [list(x) for x in listed if x[1] != into]}
    number = len([n for n in _names(spark, folder) if n.endswith(_RECORD)])
    _put(spark, f"{folder}/{number:010d}-{uuid.uuid4().hex[:8]}{_RECORD}", json.dumps(record))


def replace_pieces(df: DataFrame, root: str, table: str, piece: str, listed: list[tuple[str, str]],
                   kind: str = "compact", note: dict | None = None) -> None:
    """Put ``df`` in the place of the listed pieces in one step, however many days they cover.

    A run that dies before the record is published leaves a hidden piece; the same call again replaces it.
    """
    spark = df.sparkSession
    mark, fs = _path(spark, f"{root}/_pending/{table}/{piece}")
    fs.mkdirs(mark.getParent())
    fs.create(mark, True).close()
    write_piece(df, root, table, piece)
    mark_folded(spark, root, table, listed, piece, kind, note)
    fs.delete(mark, False)


def vacuum(spark: SparkSession, root: str, table: str, grace_seconds: float = GRACE_SECONDS) -> int:
    """Delete the files of pieces replaced more than ``grace_seconds`` ago; the records stay, for batches replayed late.

    Returns how many swaps were cleared.  A reader may hold a plan for as long as the grace time.
    """
    folder, cleared = f"{root}/_swaps/{table}", 0
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for name in _names(spark, folder):
        if name.startswith(".") or not name.endswith(_RECORD) or name.endswith(_DONE):
            continue
        path, fs = _path(spark, f"{folder}/{name}")
        if now - fs.getFileStatus(path).getModificationTime() < grace_seconds * 1000:
            continue
        drop_pieces(spark, root, table, [tuple(x) for x in json.loads(_record_text(spark, f"{folder}/{name}"))["folded"]])
        fs.rename(path, _path(spark, f"{folder}/{name[:-len(_RECORD)]}{_DONE}")[0])
        cleared += 1
    return cleared


def folded_days(spark: SparkSession, root: str, table: str, piece: str) -> list[str]:
    """Days on which a piece is part of another one."""
    return sorted(day for day, name in swaps(spark, root, table).folded() if name == piece)


def read_bronze(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, root, t) for t in C.BRONZE_TABLES}


def read_silver(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, root, t) for t in C.SILVER_TABLES}


def stage(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write an intermediate once and read it back.

    Several outputs then share one evaluation of the input, and a lost executor costs a
    re-read of columnar files, not a re-parse.  Writing the same name again replaces it.
    """
    path = f"{root}/_staging/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, root: str, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_staging/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_bronze(signals: DataFrame, root: str, piece: str) -> None:
    """Split a mixed set of accepted signals by destination and write four tables."""
    staged = stage(signals, root, f"signals-{piece}")
    for table, rows in mapping.to_bronze(staged).items():
        write_piece(rows, root, table, piece)
    unstage(signals.sparkSession, root, f"signals-{piece}")


def retain(df: DataFrame, as_of, days: int = C.RETENTION_DAYS, date: str = "event_date"):
    """Rows young enough to keep.  On a partitioned table this prunes whole partitions."""
    return df.filter(F.col(date) >= F.date_sub(F.to_date(F.lit(as_of)), days))


def apply_column_map(signals: DataFrame, kind: str, columns: dict[str, str] | None = None):
    """Canonical fields of one signal kind under their configured column names."""
    columns = columns or C.COLUMN_MAP[kind]
    known = C.COLUMN_MAP[kind]
    rows = signals.filter(F.col("signal_type") == kind)
    if kind == "span":
        rows = rows.withColumn("duration_nano",
                               F.col("end_unix_nano") - F.col("start_unix_nano"))
    return rows.select(*[F.col(field).alias(name) for field, name in columns.items()
                         if field in known])


def compact(spark: SparkSession, root: str, table: str, compaction_id: str, dates: list[str],
            merge=None, check=None) -> None:
    """Fold the pieces some dates have now into one, merging partial aggregates when told how.

    ``check(staged, listed)`` is called before the swap and may raise.

    The list of pieces is stored first, then exactly these are read, staged and replaced in one
    step; a piece that arrives at any time after the listing stays.  A run that
    dies later resumes from its list and its finished staging folder.  Give every compaction an
    id of its own: the files of a piece written twice are replaced in place.
    """
    staging = f"{root}/_staging/{table}-{compaction_id}"
    listing = f"{root}/_staging/{table}-{compaction_id}-pieces"
    if not exists(spark, f"{listing}/_SUCCESS"):
        spark.createDataFrame(list_pieces(spark, root, table, dates), "day string, folded string"
                              ).coalesce(1).write.mode("overwrite").parquet(listing)
    listed = [(r["day"], r["folded"]) for r in spark.read.schema(
        "day string, folded string").parquet(listing).collect()]
    if listed:
        if not exists(spark, f"{staging}/_SUCCESS"):
            rows = read_pieces(spark, root, table, listed)
            (merge(rows) if merge else rows).write.mode("overwrite").parquet(staging)
        staged = spark.read.schema(table_ddl(table)).parquet(staging)
        if check:
            check(staged, listed)
        replace_pieces(staged, root, table, compaction_id, listed)
    vacuum(spark, root, table)
    unstage(spark, root, f"{table}-{compaction_id}")
    unstage(spark, root, f"{table}-{compaction_id}-pieces")


def drop_pieces(spark: SparkSession, root: str, table: str,
                listed: list[tuple[str, str]]) -> None:
    """Remove exactly the listed pieces."""
    jvm, date = spark._jvm, date_column(table)
    for day, piece in listed:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/{date}={day}/{PIECE}={piece}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dates_of(spark: SparkSession, root: str, table: str) -> list[str]:
    """The date partitions a table has, by name."""
    jvm, date = spark._jvm, date_column(table)
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return sorted(n[len(date) + 1:] for n in names if n.startswith(f"{date}="))


def _leaves(state: Swaps, day: str, piece: str) -> set[str]:
    """The pieces that a piece of one day was folded from, through all folds; itself where it was written as it is."""
    own = {p for r in state.records if r["into"] == piece for d, p in r["folded"] if d == day}
    return set().union(*(_leaves(state, day, p) for p in own)) if own else {piece}


def covered_days(spark: SparkSession, root: str, model: str, sources: tuple[str, ...]) -> DataFrame:
    """``(covered_day)``: days on which ``model`` stands for every stored piece of its source tables.

    A writer gives one batch the same piece name everywhere, so names tell; folded pieces count as what they were folded
    from.  Only names are read.
    """
    def leaves(table: str, day: str) -> set[str]:
        found, state = settled(spark, root, table, lambda: list_pieces(spark, root, table, [day]))
        return set().union(*(_leaves(state, day, p) for _, p in found)) if found else set()

    days = sorted({d for t in sources for d in dates_of(spark, root, t)})
    folded = swaps(spark, root, model).folded()
    full = [d for d in days if set().union(*(leaves(t, d) for t in sources)) <= leaves(model, d) | {
        p for day, p in folded if day == d}]
    return spark.createDataFrame([(d,) for d in full], "day string").select(F.to_date("day").alias("covered_day"))


def drop_expired(spark: SparkSession, root: str, as_of,
                 days: dict[str, int] | None = None) -> list[tuple[str, str]]:
    """Delete the date partitions past retention; returns ``(table, date)`` of what went.

    Every table keeps ``RETENTION_DAYS``, call edges ``EDGE_RETENTION_DAYS``; ``days`` may say
    otherwise for single tables.  Nothing inside a kept date is touched.
    """
    gone = []
    for table in LAYOUT:
        keep = (days or {}).get(table, C.EDGE_RETENTION_DAYS if table == C.EDGE_TABLE
                                else C.RETENTION_DAYS)
        first = spark.range(1).select(
            F.date_sub(F.to_date(F.lit(as_of)), keep).cast("string")).first()[0]
        for day in dates_of(spark, root, table):
            if day < first:
                path = spark._jvm.org.apache.hadoop.fs.Path(
                    f"{root}/{table}/{date_column(table)}={day}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                sums, fs = _path(spark, f"{sums_path(root, table)}/day={day}")
                fs.delete(sums, True)
                gone.append((table, day))
    return gone
