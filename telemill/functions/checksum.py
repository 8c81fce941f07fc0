"""Order-independent content hash of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def row_hash(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """64-bit hash of all columns but those to ``skip``; maps are hashed as their sorted entries."""
    parts = []
    for f in sorted((f for f in df.schema.fields if f.name not in skip), key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        parts.append(F.sort_array(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c)
    return F.xxhash64(*parts)


def content_checksum(df: DataFrame, by: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Row count and sum of row hashes, of the table or per group.  Empty tables hash to 0."""
    hashed = df.select(*(by or []), row_hash(df, skip).cast("decimal(28,0)").alias("_h"))
    return hashed.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("_h"), F.lit(0)).cast("decimal(38,0)").alias("content_hash"))


def checksum_by_parts(df: DataFrame, part: Column, **more: Column) -> DataFrame:
    """Row count, sum of row hashes and sums of ``more`` per part and, with ``whole``, of the table, from one pass.

    Each sum is taken of the rows; that of the table is not the sum of its parts' sums.
    """
    hashed = df.select(part.alias("_of"), row_hash(df).cast("decimal(28,0)").alias("_h"),
                       *[c.alias(n) for n, c in more.items()])
    return hashed.rollup("_of").agg(
        (F.grouping("_of") == 1).alias("whole"), F.count("*").alias("rows"),
        F.sum("_h").cast("decimal(38,0)").alias("content_hash"), *[F.sum(n).alias(n) for n in more])


def text_hash(*columns: str) -> Column:
    """32 bits of the md5 of some columns' text, which any engine can compute."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
