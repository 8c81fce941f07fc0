"""Checksums of pieces, kept so that tables can be compared without reading them again.

``seal`` reads each piece once in its life and appends its row count and additive row hash, by day, to a small table.  The
checksum of a table is then the sum over its visible pieces; a compaction is right if the new piece sums to what it
replaces; ``altered`` finds pieces whose files no longer say what was sealed.  A piece written again under its name is
marked by the writer, before and after, and counts as not sealed until the next ``seal``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill import schemas as S
from telemill.functions.checksum import content_checksum
from telemill.sources import tables as TB


class SumsDiffer(RuntimeError):
    """Stored rows do not add up to what was sealed."""


def _measured(spark: SparkSession, root: str, table: str, listed: list[tuple[str, str]]) -> DataFrame:
    """``(day, piece, rows, content_hash)`` of stored pieces, read now."""
    rows = TB.read_pieces(spark, root, table, listed, keep_piece=True)
    named = rows.withColumnRenamed(TB.PIECE, "_piece").withColumn("_day", F.col(TB.date_column(table)).cast("string"))
    plain = content_checksum(named, ["_day", "_piece"], skip=("_day", "_piece"))
    return plain.select(F.col("_day").alias("day"), F.col("_piece").alias("piece"), "rows", "content_hash")


def _append(sums: DataFrame, root: str, table: str) -> None:
    """One row a day and piece."""
    sums.coalesce(1).write.mode("append").partitionBy("day").parquet(TB.sums_path(root, table))


def sealed(spark: SparkSession, root: str, table: str, listed: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(day, piece, rows, content_hash)`` of visible pieces that are sealed; of the ``listed`` ones if given."""
    path = TB.sums_path(root, table)
    if listed is None:
        listed = TB.list_pieces(spark, root, table, TB.dates_of(spark, root, table))
    versions = TB.rewrites(spark, root, table)
    names = [(day, piece, versions.get(piece, 0)) for day, piece in listed]
    if not names or not TB.exists(spark, path):
        return spark.createDataFrame([], S.SUMS_DDL).drop("version")
    wanted = spark.createDataFrame(names, "day string, piece string, version int")
    # Sealed twice, by two runs at once, a piece still counts once.
    return spark.read.schema(S.SUMS_DDL).parquet(path).join(wanted, ["day", "piece", "version"], "left_semi").select(
        "day", "piece", "rows", "content_hash").distinct()


def seal(spark: SparkSession, root: str, table: str, listed: list[tuple[str, str]] | None = None) -> int:
    """Measure the pieces that are not sealed; returns how many were."""
    if listed is None:
        listed = TB.list_pieces(spark, root, table, TB.dates_of(spark, root, table))
    versions = TB.rewrites(spark, root, table)
    known = {(r["day"], r["piece"]) for r in sealed(spark, root, table, listed).select("day", "piece").collect()}
    todo = [x for x in listed if x not in known]
    if todo:
        _keep(_measured(spark, root, table, todo), root, table, versions)
    return len(todo)


def _keep(sums: DataFrame, root: str, table: str, versions: dict[str, int]) -> None:
    again = sums.sparkSession.createDataFrame(list(versions.items()), "piece string, version int")
    numbered = sums.join(again, "piece", "left").withColumn("version", F.coalesce("version", F.lit(0)))
    _append(numbered.select("piece", "rows", "content_hash", "version", "day"), root, table)


def by_day(spark: SparkSession, root: str, table: str, listed: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(day, rows, content_hash)`` of a table from what is sealed; no data is read."""
    return sealed(spark, root, table, listed).groupBy("day").agg(
        F.sum("rows").alias("rows"), F.sum("content_hash").cast("decimal(38,0)").alias("content_hash"))


def altered(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``(day, piece, rows, sealed_rows)`` of sealed pieces whose stored rows differ from what was sealed, or are gone."""
    kept = sealed(spark, root, table)
    listed = [(r["day"], r["piece"]) for r in kept.select("day", "piece").collect()]
    now = _measured(spark, root, table, listed).select("day", "piece", "rows", F.col("content_hash").alias("now"))
    was = kept.select("day", "piece", F.col("rows").alias("sealed_rows"), "content_hash")
    return was.join(now, ["day", "piece"], "left").where(
        ~(F.col("now").eqNullSafe(F.col("content_hash")) & F.col("rows").eqNullSafe(F.col("sealed_rows")))).select(
        "day", "piece", F.coalesce("rows", F.lit(0)).alias("rows"), "sealed_rows")


def compact(spark: SparkSession, root: str, table: str, compaction_id: str, dates: list[str]) -> None:
    """As ``tables.compact``; the new piece must add up to the ones it replaces before it takes their place."""
    def check(staged: DataFrame, listed: list[tuple[str, str]]) -> None:
        seal(spark, root, table, listed)
        day = F.col(TB.date_column(table)).cast("string")
        now = content_checksum(staged.withColumn("_day", day), ["_day"], skip=("_day",)).withColumnRenamed("_day", "day")
        was = by_day(spark, root, table, listed).toDF("day", "old_rows", "old_hash")
        off = now.join(was, "day", "full").where(~(
            F.col("rows").eqNullSafe(F.col("old_rows")) & F.col("content_hash").eqNullSafe(F.col("old_hash"))))
        bad = sorted(r["day"] for r in off.select("day").collect())
        if bad:
            raise SumsDiffer(f"{table}: {compaction_id} differs from its pieces on {', '.join(bad)}")

    TB.compact(spark, root, table, compaction_id, dates, check=check)
    seal(spark, root, table, [x for x in TB.list_pieces(spark, root, table, dates) if x[1] == compaction_id])
