"""Mergeable partial aggregates per minute, and how partials merge again.

A partial covers some slice of the data (a stream batch, a day).  Any number of partials
may exist for one key; reading merges them with each column's own combinator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill.functions.columns import bucket

SIGNAL_OF = {"log_events": "log", "operation_executions": "trace",
             "metric_observations": "metric"}
METRIC_KEYS = ["window_start", "scenario", "service_name", "component_name", "metric_name",
               "metric_kind"]
VOLUME_KEYS = ["window_start", "service_name", "signal"]


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("window_start"))


def metric_stats_1m(observations: DataFrame, width: str = "minute") -> DataFrame:
    v = F.col("value")
    return _dated(
        observations.withColumn("window_start", bucket("event_time", width))
        .groupBy(*METRIC_KEYS)
        .agg(F.count("*").alias("sample_count"), F.sum(v).alias("sum_value"),
             F.sum(v * v).alias("sum_squares"), F.min(v).alias("min_value"),
             F.max(v).alias("max_value")))


def merge_metric_stats(partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or [*METRIC_KEYS, "event_date"]
    return partials.groupBy(*keys).agg(
        F.sum("sample_count").alias("sample_count"), F.sum("sum_value").alias("sum_value"),
        F.sum("sum_squares").alias("sum_squares"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"))


def with_moments(stats: DataFrame) -> DataFrame:
    """Mean and population deviation from count, sum and sum of squares."""
    n, s, q = F.col("sample_count"), F.col("sum_value"), F.col("sum_squares")
    mean = s / n
    return stats.withColumn("avg_value", mean).withColumn(
        "stddev_value", F.sqrt(F.greatest(F.lit(0.0), q / n - mean * mean)))


def metric_rollup_merged(partials: DataFrame) -> DataFrame:
    """Read view over the stored partials."""
    return with_moments(merge_metric_stats(partials, METRIC_KEYS))


def metric_rollup_direct(observations: DataFrame, width: str = "minute") -> DataFrame:
    """Same view straight from the observations, used until every day has partials."""
    v = F.col("value")
    return (
        observations.withColumn("window_start", bucket("event_time", width))
        .groupBy(*METRIC_KEYS)
        .agg(F.count("*").alias("sample_count"), F.sum(v).alias("sum_value"),
             F.sum(v * v).alias("sum_squares"), F.min(v).alias("min_value"),
             F.max(v).alias("max_value"), F.avg(v).alias("avg_value"),
             F.stddev_pop(v).alias("stddev_value")))


def metric_stats_window(partials: DataFrame) -> DataFrame:
    """Statistics per minute, producer and metric, over all scenarios and components."""
    return with_moments(merge_metric_stats(
        partials, ["window_start", "service_name", "metric_name", "metric_kind"]))


def _all_signals(silver: dict[str, DataFrame], width: str, *columns) -> DataFrame:
    out = None
    for table, signal in SIGNAL_OF.items():
        if table not in silver:
            continue
        part = silver[table].select(bucket("event_time", width).alias("window_start"),
                                    "service_name", F.lit(signal).alias("signal"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def volume_1m(silver: dict[str, DataFrame], width: str = "minute") -> DataFrame:
    return _dated(_all_signals(silver, width).groupBy(*VOLUME_KEYS)
                  .agg(F.count("*").alias("rows")))


def merge_volume(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*VOLUME_KEYS, "event_date").agg(F.sum("rows").alias("rows"))


def _fold_keys(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, n) with a null key for "all rows" -> (keys, rows, key_counts)."""
    entry = F.when(F.col("key").isNotNull(), F.struct(F.col("key"), F.col("n").alias("value")))
    return counted.groupBy(*keys).agg(
        F.max(F.when(F.col("key").isNull(), F.col("n"))).alias("rows"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("key_counts"))


def resource_key_presence_1m(silver: dict[str, DataFrame], width: str = "minute") -> DataFrame:
    """Rows per bucket and, per attribute key, the rows that carry it.

    Rows with the same set of keys collapse first (producers use few shapes), so only
    counts are spread over keys.  Every shape also emits one null key, which counts the rows
    themselves: a row with an empty map is still counted, without a second pass or a join.
    """
    # Keys are taken in the order of the map: another order of one set is only one more shape.
    rows = _all_signals(silver, width, F.coalesce(
        F.map_keys("resource_attributes"), F.array().cast("array<string>")).alias("shape"))
    shapes = rows.groupBy(*VOLUME_KEYS, "shape").agg(F.count("*").alias("c"))
    present = F.concat(F.array(F.lit(None).cast("string")), F.col("shape"))
    counted = (shapes.select(*VOLUME_KEYS, "c", F.explode(present).alias("key"))
               .groupBy(*VOLUME_KEYS, "key").agg(F.sum("c").alias("n")))
    return _dated(_fold_keys(counted, VOLUME_KEYS))


def key_sets_1m(silver: dict[str, DataFrame], width: str = "minute") -> DataFrame:
    """Rows per bucket and set of attribute keys: what key presence and violations are answered from.

    Producers use few sets, so a bucket has few rows; unlike counts per key they also tell how many rows lack any of
    several keys.
    """
    rows = _all_signals(silver, width, F.coalesce(
        F.map_keys("resource_attributes"), F.array().cast("array<string>")).alias("shape"))
    shapes = rows.groupBy(*VOLUME_KEYS, "shape").agg(F.count("*").alias("c"))
    # One set in another order of keys is the same set; sorting after the count sorts shapes, not rows.
    return _dated(shapes.groupBy(*VOLUME_KEYS, F.sort_array("shape").alias("keys")).agg(F.sum("c").alias("rows")))


def merge_key_sets(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*VOLUME_KEYS, "keys", "event_date").agg(F.sum("rows").alias("rows"))


def key_presence_from_sets(sets: DataFrame) -> DataFrame:
    """The presence model from counted key sets."""
    present = F.concat(F.array(F.lit(None).cast("string")), F.col("keys"))
    counted = sets.select(*VOLUME_KEYS, "rows", F.explode(present).alias("key")).groupBy(*VOLUME_KEYS, "key").agg(
        F.sum("rows").alias("n"))
    return _dated(_fold_keys(counted, VOLUME_KEYS))


def merge_key_presence(partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or [*VOLUME_KEYS, "event_date"]
    entries = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("rows").alias("value"))),
        F.map_entries("key_counts"))
    counted = (partials.select(*keys, F.explode(entries).alias("e"))
               .groupBy(*keys, F.col("e.key").alias("key"))
               .agg(F.sum("e.value").alias("n")))
    return _fold_keys(counted, keys)


def rows_missing_key(partials: DataFrame) -> DataFrame:
    """Rows without each known key.  Summing this over keys does not count bad rows."""
    merged = merge_key_presence(partials, ["service_name", "signal"])
    return merged.select("service_name", "signal", "rows",
                         F.explode("key_counts").alias("key", "present")).select(
        "service_name", "signal", "rows", "key",
        (F.col("rows") - F.col("present")).alias("rows_missing_key"))


def all_rollups(silver: dict[str, DataFrame], width: str = "minute") -> dict[str, DataFrame]:
    out = {"volume_1m": volume_1m(silver, width),
           "resource_key_presence_1m": resource_key_presence_1m(silver, width)}
    if "metric_observations" in silver:
        out["metric_stats_1m"] = metric_stats_1m(silver["metric_observations"], width)
    return out


MERGERS = {"metric_stats_1m": merge_metric_stats, "volume_1m": merge_volume,
           "resource_key_presence_1m": merge_key_presence}


def bronze_metric_baseline(gauge: DataFrame, sums: DataFrame, scenario_key: str,
                           width: str = "minute") -> DataFrame:
    """Per-metric statistics straight from the bronze points."""
    from telemill.functions.columns import attr

    def part(points):
        return points.select(
            F.col("ServiceName").alias("service_name"), F.col("MetricName").alias("metric_name"),
            attr("ResourceAttributes", scenario_key).alias("scenario"),
            bucket("TimeUnix", width).alias("window_start"), F.col("Value").alias("v"))

    v = F.col("v")
    return part(gauge).unionByName(part(sums)).groupBy(
        "service_name", "metric_name", "scenario", "window_start").agg(
        F.count("*").alias("cnt"), F.sum(v).alias("sum_val"), F.sum(v * v).alias("sum_sq"),
        F.min(v).alias("min_val"), F.max(v).alias("max_val"))
