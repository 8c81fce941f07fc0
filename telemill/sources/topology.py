"""Declared components -> nodes and edges.

A declaration is a table ``(component, kind, service, depends_on, base_rate, base_latency_ms,
error_ratio)``, read from a file or given as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DDL = ("component string, kind string, service string, depends_on array<string>,"
       "base_rate double, base_latency_ms double, error_ratio double")


def read_declaration(spark: SparkSession, path: str) -> DataFrame:
    """A declaration stored as JSON lines, or as Parquet where the path says so."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(DDL).parquet(path)
    return spark.read.schema(DDL).json(path)


def read_topology(spark: SparkSession, declared: DataFrame | str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges).  An edge follows the data: from the upstream to its consumer.

    A component without upstream is a root; an upstream that is not declared gives no edge.
    """
    table = read_declaration(spark, declared) if isinstance(declared, str) else declared
    upstream = F.coalesce("depends_on", F.array().cast("array<string>"))
    nodes = table.select("component", "service", "kind", "base_rate", "base_latency_ms",
                         "error_ratio", (F.size(upstream) == 0).alias("is_root"))
    wanted = table.select(F.explode(upstream).alias("src_component"),
                          F.col("component").alias("dst_component"),
                          F.col("service").alias("dst_service"))
    known = table.select(F.col("component").alias("src_component"),
                         F.col("service").alias("src_service"))
    edges = wanted.join(known, "src_component").select(
        "src_component", "dst_component", "src_service", "dst_service")
    return nodes, edges
