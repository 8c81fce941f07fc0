"""Declared topology against what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill import contract as C
from telemill.functions.columns import one_value, rate_of


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_service").alias("src"), F.col("dst_service").alias("dst")
                        ).distinct()


def undeclared_edges(observed: DataFrame, declared_edges: DataFrame) -> DataFrame:
    """Observed caller -> callee pairs no declaration contains."""
    return observed.join(_pairs(declared_edges), ["src", "dst"], "left_anti")


def undeclared_producers(bronze: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """Producers that write data and appear in no declared component."""
    seen = None
    for df in bronze.values():
        part = df.select(F.col("ServiceName").alias("service"))
        seen = part if seen is None else seen.unionByName(part)
    return seen.filter(F.col("service") != "").distinct().join(
        nodes.select("service"), "service", "left_anti")


def declared_vs_observed_edges(observed: DataFrame, declared_edges: DataFrame) -> DataFrame:
    declared = _pairs(declared_edges).withColumn("is_declared", F.lit(True))
    both = observed.withColumn("is_observed", F.lit(True)).join(declared, ["src", "dst"],
                                                                "full_outer")
    return both.select(
        "src", "dst", F.coalesce("spans", F.lit(0)).alias("spans"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        rate_of(F.coalesce("errors", F.lit(0)), F.coalesce("spans", F.lit(0)))
        .alias("error_rate"),
        F.when(F.col("is_observed").isNull(), F.lit("declared-only"))
        .when(F.col("is_declared").isNull(), F.lit("observed-only"))
        .otherwise(F.lit("both")).alias("status"))


def edge_health(observed: DataFrame, declared_edges: DataFrame) -> DataFrame:
    """Per declared edge: traffic, share of the busiest observed edge, error class."""
    peak = one_value(observed, F.greatest(F.lit(1), F.coalesce(F.max("spans"), F.lit(1))))
    joined = _pairs(declared_edges).join(observed, ["src", "dst"], "left")
    rate = F.when(F.col("spans").isNotNull(), rate_of("errors", "spans"))
    return joined.select(
        "src", "dst", "spans", "errors", (F.col("spans") / peak).alias("share_of_peak"),
        rate.alias("error_rate"),
        F.when(F.col("spans").isNull(), F.lit("declared-only"))
        .when(rate >= C.EDGE_FAIL_RATE, F.lit("fail"))
        .when(rate >= C.EDGE_WARN_RATE, F.lit("warn"))
        .otherwise(F.lit("ok")).alias("class"))


def declared_vs_measured(nodes: DataFrame, health: DataFrame) -> DataFrame:
    """Declared latency and error ratio beside the measured ones."""
    measured = health.withColumnRenamed("service_name", "service")
    return nodes.join(measured, "service", "left").select(
        "component", "service", "base_latency_ms", "error_ratio", "p50", "p99", "error_rate",
        (F.col("p50") - F.col("base_latency_ms")).alias("p50_over_declared"),
        (F.col("error_rate") - F.col("error_ratio")).alias("error_over_declared"))
