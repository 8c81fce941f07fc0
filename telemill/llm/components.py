"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregate and a join; a star with a huge centre only makes a skewed join, which
adaptive execution splits.  The link table never grows, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill.llm.shared import stage


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with a link; the component is its smallest node.

    Self links, repeated links and links with a null end are ignored.  ``rounds`` is a guard against a
    fault: the number needed grows with the logarithm of the longest chain, and running out raises.
    """
    state = stage(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links")
    seen = _digest(state)
    for _ in range(rounds):
        if not seen[0]:
            break
        state = stage(_small(_large(state)), "links")
        now = _digest(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
