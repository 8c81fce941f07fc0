"""Exact quantiles of every group, without ever sorting one whole group in one task.

Definition: for n values the p-quantile is the element at 0-based position
``floor(p * n)`` of the sorted group (so the median of 1, 2, 3, 4 is 3).

A plain ``row_number`` window would send a whole group to one task; a group may hold a
third of all rows.  So the search is refined in two steps:

1. collapse equal values (map-side combined) and give each value an order-preserving
   *slot* on a logarithmic scale.  The number of slots is bounded by the number range,
   not by the number of rows;
2. cumulative slot counts tell which slot holds each wanted position; only the values of
   those slots are ranked, one (group, slot) per window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from telemill.functions.columns import col, int_div

SLOTS_PER_E = 256


def slot_of(value) -> Column:
    """Monotone, coarse image of a number: equal slots are within 0.4 % of each other."""
    v = col(value).cast("double")
    scaled = F.floor(F.log1p(F.abs(v)) * SLOTS_PER_E)
    return F.when(v < 0, -scaled).otherwise(scaled)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, tuple[int, int]],
    *,
    count: str = "n",
    maximum: str | None = None,
    flags: dict[str, Column] | None = None,
) -> DataFrame:
    """Group ``df`` by ``keys``; one column per quantile given as ``name: (num, den)``.

    ``count`` names the row count, ``maximum`` the largest value, and each flag becomes the
    number of rows where its condition holds - all from the same pass.
    """
    flags = flags or {}
    values = (
        df.groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_w"),
             *[F.count_if(cond).alias(f"_f_{name}") for name, cond in flags.items()])
        .withColumn("_slot", slot_of("_v"))
    )
    slots = values.groupBy(*keys, "_slot").agg(
        F.sum("_w").alias("_w"), F.max("_v").alias("_hi"),
        *[F.sum(f"_f_{name}").alias(f"_f_{name}") for name in flags])
    # Both sides ask for the same columns, so that the source is read and shuffled once.
    counted = values
    for name in flags:
        counted = counted.filter(F.col(f"_f_{name}") >= 0)
    return from_slots(slots, counted, keys, quantiles, count=count, maximum=maximum, flags=tuple(flags))


def from_slots(slots: DataFrame, values: DataFrame, keys: list[str], quantiles: dict[str, tuple[int, int]], *,
               count: str = "n", maximum: str | None = None, flags: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles from slot counts ``(keys, _slot, _w, _hi, _f_<flag>)``, refined once from the values of the slots hit.

    ``values`` are ``(keys, _slot, _v, _w)``: distinct values and how often they occur.
    """
    group = W.partitionBy(*keys)
    upto = group.orderBy("_slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    slots = (
        slots.withColumn("_before", F.sum("_w").over(upto) - F.col("_w"))
        .withColumn("_n", F.sum("_w").over(group))
        .withColumn("_max", F.max("_hi").over(group))
    )
    for name in flags:
        slots = slots.withColumn(f"_t_{name}", F.sum(f"_f_{name}").over(group))

    wanted = []
    for name, (num, den) in quantiles.items():
        position = F.least(int_div(F.col("_n") * num, den), F.col("_n") - 1)
        inside = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_w"))
        slots = slots.withColumn(f"_p_{name}", F.when(inside, position))
        wanted.append(F.col(f"_p_{name}").isNotNull())
    any_wanted = wanted[0]
    for w in wanted[1:]:
        any_wanted = any_wanted | w
    hits = slots.filter(any_wanted).select(
        *[F.col(k).alias(f"_h_{k}") for k in [*keys, "_slot"]], "_before", "_n", "_max",
        *[f"_t_{name}" for name in flags], *[f"_p_{name}" for name in quantiles])

    within = W.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    same = F.lit(True)
    for k in [*keys, "_slot"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    joined = values.select(*keys, "_slot", "_v", "_w").join(hits, same, "inner")
    ranked = joined.withColumn("_end", F.col("_before") + F.sum("_w").over(within))
    pick = [
        F.max(F.when((F.col("_end") - F.col("_w") <= F.col(f"_p_{name}"))
                     & (F.col(f"_p_{name}") < F.col("_end")), F.col("_v"))).alias(name)
        for name in quantiles
    ]
    extra = [F.max(f"_t_{name}").alias(name) for name in flags]
    if maximum:
        extra.append(F.max("_max").alias(maximum))
    return ranked.groupBy(*keys).agg(F.max("_n").alias(count), *extra, *pick)
