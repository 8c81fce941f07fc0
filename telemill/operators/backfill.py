"""Rebuild whole days of silver and rollup tables from what lies below them.

A range of days is one Spark job per table.  Every day is rebuilt in a staging folder,
compared with what it was built from by additive facts (``proofs``), its sources with their sealed
checksums (``sums``), and only then replaces the live partition, all days of a table in one step.  Each step leaves a
ledger row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill import contract as C, schemas as S
from telemill.operators import proofs as PR, silver as SV
from telemill.plans import rollups
from telemill.sources import sums as SM, tables as TB

LEDGER = "backfill_runs"
PHASE_1, PHASE_2 = "phase1", "phase2"
_SOURCES = {"log_events": ("otel_logs",), "operation_executions": ("otel_traces",),
            "metric_observations": ("otel_metrics_gauge", "otel_metrics_sum")}


class BackfillRefused(RuntimeError):
    """The range is live, or a day lacks the phase it builds on."""


class BackfillFailed(RuntimeError):
    """A rebuilt day did not match; its live partition was left alone."""


# -- ledger -------------------------------------------------------------------


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/{LEDGER}"
    if not TB.exists(spark, path):
        return spark.createDataFrame([], S.LEDGER_DDL)
    return spark.read.schema(S.LEDGER_DDL).parquet(path)


def _record(spark: SparkSession, root: str, rows: list[dict]) -> None:
    """Append a few control rows; this is bookkeeping, never data."""
    names = [f.split()[0] for f in TB._split(S.LEDGER_DDL)]
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    defaults = {"bronze_rows_before": 0, "bronze_rows_after": 0, "silver_rows_written": 0,
                "content_hash": 0, "expected_hash": 0, "started_at": now, "finished_at": now}
    types = {"content_hash": str, "expected_hash": str}
    data = []
    for row in rows:
        full = {**defaults, **row}
        data.append(tuple(types.get(n, lambda v: v)(full[n]) for n in names))
    text = S.LEDGER_DDL.replace("decimal(38,0)", "string")
    spark.createDataFrame(data, text).select(*[
        F.col(n).cast("decimal(38,0)").alias(n) if n in types else F.col(n) for n in names
    ]).coalesce(1).write.mode("append").parquet(f"{root}/{LEDGER}")


def live_partition_refusal(spark: SparkSession, root: str, to_day: str, as_of_day: str,
                           run_id: str) -> None:
    """A range that reaches today is refused and recorded; there is no override."""
    if to_day >= as_of_day:
        _record(spark, root, [{"run_id": run_id, "phase": PHASE_1,
                               "target_table": "log_events", "partition_id": to_day,
                               "status": "refused"}])
        raise BackfillRefused(f"live partition range refused (to={to_day}, today={as_of_day})")


# -- which days ---------------------------------------------------------------


def partitions_present(tables: dict[str, DataFrame], from_day: str, to_day: str) -> DataFrame:
    """Days inside the range that any of the tables holds."""
    out = None
    for name, df in tables.items():
        day = F.col(TB.date_column(name))
        part = df.filter(day.between(F.to_date(F.lit(from_day)), F.to_date(F.lit(to_day)))
                         ).select(day.cast("string").alias("partition_id"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def missing_backfill_partitions(base_days: DataFrame, ledger: DataFrame,
                                target: str = "metric_stats_1m") -> DataFrame:
    """Base days without a finished phase-2 run of the target."""
    done = ledger.filter((F.col("phase") == PHASE_2) & (F.col("target_table") == target)
                         & (F.col("status") == "ok")).select("partition_id").distinct()
    return base_days.join(done, "partition_id", "left_anti")


def rollup_ready_gate(base_days: DataFrame, ledger: DataFrame,
                      target: str = "metric_stats_1m") -> DataFrame:
    """One row: may the merged rollup view replace the direct one?"""
    missing = missing_backfill_partitions(base_days, ledger, target)
    return missing.agg((F.count("*") == 0).alias("ready"),
                       F.array_join(F.sort_array(F.collect_list("partition_id")), ", ")
                       .alias("missing"))


# -- the job ------------------------------------------------------------------


def _in_range(df: DataFrame, name: str, days: list[str]) -> DataFrame:
    return df.filter(F.col(TB.date_column(name)).isin([dt.date.fromisoformat(d) for d in days]))


def _shape(schema) -> list[tuple[str, str]]:
    return sorted((f.name, f.dataType.simpleString()) for f in schema.fields)


def _expected(table: str, source: dict[str, DataFrame]) -> dict[str, dict]:
    """Facts of the sources by day, and by source what was read of it."""
    base = table in _SOURCES
    return {n: PR.collect(PR.bronze_facts(n, df) if base else PR.source_facts(table, n, df)) for n, df in source.items()}


def _sealed(spark, root: str, listed: dict[str, list]) -> dict[str, dict[str, tuple]]:
    """Rows and hash by source and day, as sealed; pieces that were not are now."""
    out = {}
    for name, pieces in listed.items():
        SM.seal(spark, root, name, pieces)
        out[name] = {r["day"]: (r["rows"], int(r["content_hash"])) for r in SM.by_day(spark, root, name, pieces).collect()}
    return out


def _rebuild(spark, root, table, phase, run_id, days, names, build) -> None:
    """Rebuild some days of a table from exactly the source pieces that are stored now.

    A writer gives one batch the same piece name in all its tables, sources before models.
    The target's pieces are listed before the sources', so a batch that lands meanwhile is
    either in both lists or its model pieces stay; those of a batch whose source pieces were
    read but whose model pieces come later are recorded as folded.
    """
    old = TB.list_pieces(spark, root, table, days)
    listed = {n: TB.list_pieces(spark, root, n, days) for n in names}
    sources = {n: TB.read_pieces(spark, root, n, listed[n]) for n in names}
    seals = _sealed(spark, root, listed)
    before = {d: sum(own.get(d, (0, 0))[0] for own in seals.values()) for d in days}
    common = {"run_id": run_id, "phase": phase, "target_table": table}
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    _record(spark, root, [{**common, "partition_id": d, "status": "running",
                           "bronze_rows_before": before[d],
                           "bronze_rows_after": before[d]} for d in days])
    source = {n: _in_range(df, n, days) for n, df in sources.items()}
    staging = f"{root}/_staging/{table}-{run_id}"
    build(source).write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(TB.table_ddl(table)).parquet(staging)
    if _shape(spark.read.parquet(staging).schema) != _shape(TB.read_table(spark, root, table).schema):
        _record(spark, root, [{**common, "partition_id": d, "status": "failed"} for d in days])
        raise BackfillFailed(f"staging structure differs for {table}")
    parts = _expected(table, source)
    expected = PR.added(list(parts.values()))
    actual = PR.collect(PR.silver_facts(table, staged, names) if table in _SOURCES else PR.rollup_facts(table, staged))

    done, bad, ledger = [], [], []
    for d in days:
        have, wanted = actual.get(d, {}), expected.get(d, {})
        off = PR.differences(have, wanted)
        for n, own in parts.items():
            read = own.get(d, {})
            if (read.get("source_rows", 0), int(read.get("source_hash", 0))) != seals[n].get(d, (0, 0)):
                off.append(f"{n} as sealed")
        if off:
            bad.append(f"{d} ({', '.join(off)})")
        else:
            done.append(d)
        ledger.append({**common, "partition_id": d, "bronze_rows_before": before[d],
                       "bronze_rows_after": wanted.get("source_rows", 0), "silver_rows_written": have.get("stored_rows", 0),
                       "content_hash": PR.fingerprint(have), "expected_hash": PR.fingerprint(wanted),
                       "started_at": started, "status": "failed" if off else "ok"})
    if done:
        piece = f"backfill-{run_id}"
        covered = {x for part in [old, *listed.values()] for x in part
                   if x[0] in done and x[1] != piece}
        TB.replace_pieces(_in_range(staged, table, done), root, table, piece, sorted(covered),
                          kind="backfill")
        TB.vacuum(spark, root, table)
    _record(spark, root, ledger)
    if bad:
        raise BackfillFailed(f"{table}: days differ from their sources: {', '.join(bad)}")


def _days(present: DataFrame) -> list[str]:
    return [r["partition_id"] for r in present.orderBy("partition_id").collect()]


def backfill_base(spark: SparkSession, root: str, from_day: str, to_day: str, as_of_day: str,
                  run_id: str, builders=None) -> list[str]:
    """Phase 1: silver base tables from bronze, for every day bronze has in the range."""
    live_partition_refusal(spark, root, to_day, as_of_day, run_id)
    bronze = TB.read_bronze(spark, root)
    days = _days(partitions_present(bronze, from_day, to_day))
    build = {"log_events": lambda b: SV.log_events(b["otel_logs"]),
             "operation_executions": lambda b: SV.operation_executions(b["otel_traces"]),
             "metric_observations": lambda b: SV.metric_observations(
                 b["otel_metrics_gauge"], b["otel_metrics_sum"]), **(builders or {})}
    for table in ("log_events", "operation_executions", "metric_observations"):
        if days:
            _rebuild(spark, root, table, PHASE_1, run_id, days,
                     _SOURCES[table], build[table])
    return days


def backfill_rollups(spark: SparkSession, root: str, from_day: str, to_day: str,
                     as_of_day: str, run_id: str, builders=None) -> list[str]:
    """Phase 2: rollups from silver; a day needs a finished phase 1 of all base tables."""
    live_partition_refusal(spark, root, to_day, as_of_day, run_id)
    silver = TB.read_silver(spark, root)
    days = _days(partitions_present(silver, from_day, to_day))
    ready = {r["partition_id"] for r in read_ledger(spark, root).filter(
        (F.col("phase") == PHASE_1) & (F.col("status") == "ok")
        & F.col("target_table").isin(*C.SILVER_TABLES)
        & F.col("partition_id").isin(*(days or [""]))).groupBy("partition_id").agg(
        F.count_distinct("target_table").alias("n")).filter(
        F.col("n") == len(C.SILVER_TABLES)).collect()}
    refused = [d for d in days if d not in ready]
    if refused:
        _record(spark, root, [{"run_id": run_id, "phase": PHASE_2, "target_table": t,
                               "partition_id": d, "status": "refused"}
                              for t in C.ROLLUP_TABLES for d in refused])
        raise BackfillRefused(f"no finished phase 1 for {', '.join(refused)}")
    build = {"metric_stats_1m": lambda s: rollups.metric_stats_1m(s["metric_observations"]),
             "volume_1m": rollups.volume_1m,
             "resource_key_presence_1m": rollups.resource_key_presence_1m, **(builders or {})}
    for table in C.ROLLUP_TABLES:
        if days:
            used = ("metric_observations",) if table == "metric_stats_1m" else C.SILVER_TABLES
            _rebuild(spark, root, table, PHASE_2, run_id, days, used, build[table])
    return days
