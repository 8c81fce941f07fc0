"""Previous-row, trailing-row and running access on long series, as a partitioned prefix scan.

A plain window over (series, time) sorts one whole series in one task.  Here a series with more rows
than a part should hold is cut at quantiles of its own times, whatever its sampling rate.  Each part is summarised (its
last ``k`` rows, or its sums), an exclusive scan over these few rows tells every part what lies before it, and the window
then runs per (series, part).  Results are those of the plain window.  Rows of one series and one microsecond stay together.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from telemill.session import checkpoint_root

#: Rows of a series that one task should get, and the most parts of one series.
PART_ROWS = 1_000_000
MAX_PARTS = 4096
PART = "_part"


def _same(series: list[str]) -> Column:
    out = F.lit(True)
    for c in series:
        out = out & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return out


def cut(df: DataFrame, series: list[str], ts: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``_part``: the number of its series' cuts that are not after the row.

    Only series of more than ``part_rows`` rows have cuts.  They are written to the shared folder once, so that every
    reader of the result sees the same ones.
    """
    if PART in df.columns:
        return df
    of = [F.col(c).alias(f"_of_{c}") for c in series]
    sizes = df.groupBy(*of).agg(F.count(ts).alias("_n")).filter(F.col("_n") > part_rows)
    most = sizes.agg(F.max("_n")).first()[0]
    if most is None:
        return df.withColumn(PART, F.lit(0))
    parts = min(MAX_PARTS, math.ceil(most / part_rows))
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    dense = df.select(*series, ts).join(sizes, _same(series)).groupBy(*[f"_of_{c}" for c in series], "_n").agg(
        F.percentile_approx(ts, at, F.lit(20 * parts)).alias("_q"))
    # A series smaller than the largest takes every so many of the quantiles.
    own = F.least(F.lit(parts), F.ceil(F.col("_n") / part_rows)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), own - 1),
                         lambda i: F.get("_q", F.floor(i * parts / own).cast("int") - 1))
    path = f"{checkpoint_root(df.sparkSession)}/cuts-{uuid.uuid4().hex}"
    table = dense.select(*[f"_of_{c}" for c in series], F.array_distinct(chosen).alias("_cuts"))
    table.write.parquet(path)
    cuts = df.sparkSession.read.schema(table.schema).parquet(path)
    return df.join(cuts, _same(series), "left").select(*df.columns, _place(parts, F.col(ts)).alias(PART))


def _place(parts: int, value: Column) -> Column:
    """Binary search: how many of the sorted ``_cuts`` are at most ``value``; 0 without cuts."""
    steps = F.array(*[F.lit(1 << b) for b in range(parts.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get("_cuts", at + step - 1) <= value, at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def with_past(df: DataFrame, series: list[str], ts: str, k: int, ties: tuple[str, ...] = (),
              part_rows: int = PART_ROWS) -> tuple[DataFrame, list[str]]:
    """Rows plus, per part, copies of the ``k`` rows before it; and the window keys.

    Copies carry ``_copy`` = true and have to be filtered out after windowing with frames
    that reach back at most ``k`` rows.  Only the last ``k`` rows of each part travel.  Rows of one time are
    in the order of the ``ties`` columns.
    """
    rows = cut(df, series, ts, part_rows)
    end = W.partitionBy(*series, PART).orderBy(F.desc(ts), *[F.desc(c) for c in ties])
    tails = rows.withColumn("_rn", F.row_number().over(end)).filter(F.col("_rn") <= k).drop("_rn")
    ahead = W.partitionBy(*series).orderBy(ts, *ties).rowsBetween(1, k)
    copies = (
        tails.withColumn("_next", F.collect_set(PART).over(ahead))
        .withColumn("_to", F.explode(F.array_except("_next", F.array(PART))))
        .withColumn(PART, F.col("_to")).drop("_to", "_next"))
    both = rows.withColumn("_copy", F.lit(False)).unionByName(
        copies.withColumn("_copy", F.lit(True)))
    return both, [*series, PART]


def originals(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_copy")).drop("_copy", PART)


def lagged(df: DataFrame, series: list[str], ts: str, columns: list[str],
           part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``prev_<c>`` for every column and ``prev_<ts>``; null on the first row.

    Rows of one series and time follow each other in the order of ``columns``.
    """
    wanted = [ts, *[c for c in columns if c != ts]]
    ties = tuple(wanted[1:])
    rows, keys = with_past(df, series, ts, 1, ties, part_rows)
    w = W.partitionBy(*keys).orderBy(ts, *ties)
    return originals(rows.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in wanted]))


def trailing(df: DataFrame, series: list[str], ts: str, k: int, aggregates: dict[str, Column],
             part_rows: int = PART_ROWS) -> DataFrame:
    """Aggregates over each row and its ``k`` predecessors."""
    rows, keys = with_past(df, series, ts, k, part_rows=part_rows)
    w = W.partitionBy(*keys).orderBy(ts).rowsBetween(-k, 0)
    return originals(rows.select("*", *[a.over(w).alias(n) for n, a in aggregates.items()]))


def running(df: DataFrame, series: list[str], ts: str, sums: dict[str, Column], ties: tuple[str, ...] = (),
            part_rows: int = PART_ROWS) -> DataFrame:
    """Running sums of each series up to and with each row; a part adds what the parts before it sum to."""
    rows = cut(df, series, ts, part_rows).select("*", *[e.alias(n) for n, e in sums.items()])
    before = W.partitionBy(*[f"_of_{c}" for c in series]).orderBy("_of_part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in series], F.col(PART).alias("_of_part")).agg(
        *[F.sum(n).alias(f"_sum_{n}") for n in sums])
    totals = totals.select(*[f"_of_{c}" for c in series], "_of_part",
                           *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_past_{n}") for n in sums])
    here = W.partitionBy(*series, PART).orderBy(ts, *ties).rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[F.coalesce(F.sum(n).over(here), F.lit(0)).alias(f"_here_{n}") for n in sums])
    return local.join(totals, _same(series) & (F.col(PART) == F.col("_of_part"))).select(
        *df.drop(PART).columns, *[(F.col(f"_here_{n}") + F.col(f"_past_{n}")).alias(n) for n in sums])


def newest(df: DataFrame, series: list[str], ts: str, k: int) -> DataFrame:
    """The last ``k`` rows of every series; Spark prunes to k per task before shuffling."""
    w = W.partitionBy(*series).orderBy(F.desc(ts))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
