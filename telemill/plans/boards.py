"""What the boards ask: volume, lineage, contract health, coverage, producer health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telemill import contract as C
from telemill.functions import verdicts as V
from telemill.functions.columns import (
    attr, bucket, has_key, int_div, missing_any, one_value, rate_of, sorted_set)
from telemill.schemas import BRONZE_DATE

_SHORT = {"otel_logs": "logs", "otel_traces": "traces", "otel_metrics_gauge": "gauge",
          "otel_metrics_sum": "sums"}


def _top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def _union(parts) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


# -- counts -------------------------------------------------------------------


def table_counts(bronze: dict[str, DataFrame]) -> DataFrame:
    return _union(df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n")
                  for t, df in bronze.items())


def lineage(bronze: dict[str, DataFrame], limit: int | None = 12) -> DataFrame:
    """Rows per producer, split by destination table."""
    rows = _union(df.select("ServiceName", F.lit(_SHORT[t]).alias("t"))
                  for t, df in bronze.items())
    out = rows.groupBy(F.col("ServiceName").alias("service")).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("t") == t).alias(t) for t in _SHORT.values()])
    return _top(out, limit, F.desc("total"), "service")


def metric_inventory(bronze: dict[str, DataFrame]) -> DataFrame:
    """Which metric names each producer emits, and into which table."""
    rows = _union(
        bronze[t].select(F.col("ServiceName").alias("service"), F.lit(kind).alias("tbl"),
                         F.col("MetricName").alias("metric_name"))
        for t, kind in (("otel_metrics_gauge", "gauge"), ("otel_metrics_sum", "sum")))
    return rows.distinct()


def service_path(bronze: dict[str, DataFrame], service: str | None = None) -> DataFrame:
    """A producer's rows per table beside the metric names it puts there."""
    def of(df):
        return df if service is None else df.filter(F.col("service") == service)

    names = of(metric_inventory(bronze)).groupBy("service").agg(
        F.count_if(F.col("tbl") == "gauge").alias("gauge_metrics"),
        F.count_if(F.col("tbl") == "sum").alias("sum_metrics"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("tbl") == "gauge",
                                                        F.col("metric_name")))), ",")
        .alias("gauge_names"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("tbl") == "sum",
                                                        F.col("metric_name")))), ",")
        .alias("sum_names"))
    return of(lineage(bronze, limit=None)).join(names, "service", "left").na.fill(
        0, ["gauge_metrics", "sum_metrics"]).na.fill("", ["gauge_names", "sum_names"])


def model_counts(models: dict[str, DataFrame], declared: tuple[str, ...] | None = None,
                 spark: SparkSession | None = None) -> DataFrame:
    """Rows per model.  A declared model that is absent has a null count, an empty one 0."""
    out = _union(df.agg(F.count("*").alias("n")).select(F.lit(m).alias("model"), "n",
                                                        F.lit(True).alias("present"))
                 for m, df in models.items())
    absent = [m for m in (declared or ()) if m not in models]
    if absent:
        spark = spark or out.sparkSession
        out = out.unionByName(spark.createDataFrame([(m, None, False) for m in absent],
                                                    "model string, n bigint, present boolean"))
    return out


def base_coverage(silver: dict[str, DataFrame]) -> DataFrame:
    """Oldest event per base table; an empty table yields no row, not an epoch."""
    return _union(
        df.agg(F.min("event_time").alias("oldest"), F.count("*").alias("n"))
        .filter(F.col("n") > 0).select(F.lit(t).alias("tbl"), "oldest")
        for t, df in silver.items())


def coverage_gate(coverage: DataFrame, tables, minutes: int, as_of,
                  longest: int | None = None) -> DataFrame:
    """One row: may the rollup answer a window of ``minutes``, or must the raw tables?

    Every source table has to reach back to the start of the window.  ``longest`` is the
    span the rollup itself holds (the edge model keeps 24 hours).
    """
    boundary = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    tables = list(tables)
    deep = F.count_if(F.col("tbl").isin(tables) & (F.col("oldest") <= boundary))
    fits = F.lit(longest is None or minutes <= longest)
    return coverage.agg((fits & (deep == len(tables))).alias("covered")).select(
        "covered", F.when(F.col("covered"), F.lit("rollup")).otherwise(F.lit("raw"))
        .alias("source"))


def choose_source(coverage: DataFrame, tables, minutes: int, as_of,
                  longest: int | None = None) -> str:
    """The gate as a decision on the driver; one row is fetched."""
    return coverage_gate(coverage, tables, minutes, as_of, longest).first()["source"]


def fallback_removal_ready(readings: DataFrame, as_of, readings_needed: int = C.COVERAGE_READINGS,
                           days: int = C.RETENTION_DAYS) -> DataFrame:
    """True when the newest coverage readings ``(read_at, oldest)`` are all deep enough."""
    horizon = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    newest = readings.orderBy(F.desc("read_at")).limit(readings_needed)
    return newest.agg(
        ((F.count("*") >= readings_needed)
         & (F.count_if(F.col("oldest") <= horizon) == F.count("*"))).alias("ready"))


def latest_scenario(logs: DataFrame) -> DataFrame:
    scenario = attr("ResourceAttributes", C.KEY_SCENARIO)
    return logs.agg(F.max_by(scenario, F.struct(F.col("TimestampNs"), scenario.alias("s")))
                    .alias("scenario")).select(
        F.coalesce(F.when(F.col("scenario") != "", F.col("scenario")), F.lit("—"))
        .alias("scenario"))


# -- contract health ----------------------------------------------------------


def _slot(i: int) -> str:
    return f"missing_{i}"


def contract_violations(bronze: dict[str, DataFrame], keys=C.REQUIRED_RESOURCE_KEYS,
                        limit: int | None = 10, since=None) -> DataFrame:
    """Producers with rows missing a required key, from the bronze rows.

    One conditional count per key in a single aggregate; exploding the key list would
    multiply every row before filtering.  ``violating`` counts rows, so it is not the sum
    of the per-key counts ``missing_0`` .. ``missing_n`` (in the order of ``keys``).
    """
    def slim(t, df):
        if since is not None:
            time = F.col("TimeUnix" if "metrics" in t else "Timestamp")
            first = F.lit(since).cast("timestamp")
            df = df.filter((time >= first) & (F.col(BRONZE_DATE[t]) >= F.to_date(first)))
        return df.select(F.col("ServiceName").alias("service"), "ResourceAttributes")

    rows = _union(slim(t, df) for t, df in bronze.items())
    m = "ResourceAttributes"
    out = rows.groupBy("service").agg(
        F.count("*").alias("rows"),
        *[F.count_if(~has_key(m, k)).alias(_slot(i)) for i, k in enumerate(keys)],
        F.count_if(missing_any(m, keys)).alias("violating"))
    return _worst(out, keys, limit)


def _worst(out: DataFrame, keys, limit: int | None) -> DataFrame:
    total = F.lit(0)
    for i in range(len(keys)):
        total = total + F.col(_slot(i))
    names = F.array_join(F.filter(F.array(*[
        F.when(F.col(_slot(i)) > 0, F.lit(k)) for i, k in enumerate(keys)]),
        lambda k: k.isNotNull()), ",")
    out = out.withColumn("total_missing", total).withColumn("missing_keys", names).filter(
        F.col("total_missing") > 0)
    return _top(out, limit, F.desc("total_missing"), "service")


def contract_violations_from_rollup(key_presence: DataFrame, bronze: dict[str, DataFrame],
                                    keys=C.REQUIRED_RESOURCE_KEYS,
                                    limit: int | None = 10) -> DataFrame:
    """Per-key counts from the rollup, bad-row counts from bronze, matched by producer."""
    from telemill.plans.rollups import merge_key_presence

    merged = merge_key_presence(key_presence, ["service_name"])
    counts = merged.select(
        F.col("service_name").alias("service"), "rows",
        *[(F.col("rows") - F.coalesce(F.try_element_at("key_counts", F.lit(k)), F.lit(0)))
          .alias(_slot(i)) for i, k in enumerate(keys)])
    bad = _union(df.select(F.col("ServiceName").alias("service"), "ResourceAttributes")
                 for df in bronze.values()).groupBy("service").agg(
        F.count_if(missing_any("ResourceAttributes", keys)).alias("violating"))
    joined = counts.join(bad, "service", "left").withColumn(
        "violating", F.coalesce("violating", F.lit(0)))
    return _worst(joined, keys, limit)


def contract_violations_stitched(key_sets: DataFrame, bronze: dict[str, DataFrame], covered: DataFrame,
                                 keys=C.REQUIRED_RESOURCE_KEYS, limit: int | None = 10) -> DataFrame:
    """Violations from counted key sets on ``covered`` days and from bronze on all others, in one plan.

    A key set tells which keys a row lacks, so covered days are never read from bronze.
    """
    lacks = [~F.array_contains("keys", k) for k in keys]
    any_lack = lacks[0]
    for x in lacks[1:]:
        any_lack = any_lack | x
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0))
    model = key_sets.join(covered, F.col("event_date") == F.col("covered_day"), "left_semi").groupBy(
        F.col("service_name").alias("service")).agg(
        F.sum("rows").alias("n"), *[count(x).alias(_slot(i)) for i, x in enumerate(lacks)], count(any_lack).alias("violating"))
    m = "ResourceAttributes"
    rows = _union(df.join(covered, F.col(BRONZE_DATE[t]) == F.col("covered_day"), "left_anti").select(
        F.col("ServiceName").alias("service"), m) for t, df in bronze.items())
    raw = rows.groupBy("service").agg(
        F.count("*").alias("n"), *[F.count_if(~has_key(m, k)).alias(_slot(i)) for i, k in enumerate(keys)],
        F.count_if(missing_any(m, keys)).alias("violating"))
    both = model.unionByName(raw).groupBy("service").agg(
        F.sum("n").alias("rows"), *[F.sum(_slot(i)).alias(_slot(i)) for i in range(len(keys))],
        F.sum("violating").alias("violating"))
    return _worst(both, keys, limit)


def violation_share(violations: DataFrame) -> DataFrame:
    """Violating rows as a share of the producer's rows."""
    return violations.select(
        "service", "rows", "violating",
        rate_of("violating", "rows").alias("share"),
        F.when(F.col("missing_keys") == "", 0).otherwise(F.size(F.split("missing_keys", ",")))
        .alias("keys_missing"))


# -- volume -------------------------------------------------------------------


def volume_buckets(logs: DataFrame, as_of, minutes: int | None, width: str = "minute"):
    """Complete buckets of log volume per producer inside the window, from bronze."""
    ts = F.col("Timestamp")
    rows = _window(logs, ts, as_of, minutes, width)
    if minutes is not None:
        rows = rows.filter(F.col("TimestampDate") >= F.to_date(_start(as_of, minutes)))
    return rows.groupBy(F.col("ServiceName").alias("service"), bucket(ts, width).alias("t")).agg(
        F.count("*").alias("n"))


def volume_buckets_from_rollup(volume: DataFrame, as_of, minutes: int | None,
                               width: str = "minute") -> DataFrame:
    rows = _window(volume.filter(F.col("signal") == "log"), F.col("window_start"), as_of,
                   minutes, width)
    if minutes is not None:
        rows = rows.filter(F.col("event_date") >= F.to_date(_start(as_of, minutes)))
    return rows.groupBy(F.col("service_name").alias("service"),
                        bucket("window_start", width).alias("t")).agg(F.sum("rows").alias("n"))


def volume_buckets_stitched(volume: DataFrame, logs: DataFrame, covered: DataFrame, as_of, minutes: int | None,
                            width: str = "minute") -> DataFrame:
    """Buckets from the volume model on ``covered`` days and from the logs on all others, in one plan."""
    model = volume.join(covered, F.col("event_date") == F.col("covered_day"), "left_semi")
    raw = logs.join(covered, F.col("TimestampDate") == F.col("covered_day"), "left_anti")
    return volume_buckets_from_rollup(model, as_of, minutes, width).unionByName(
        volume_buckets(raw, as_of, minutes, width)).groupBy("service", "t").agg(F.sum("n").alias("n"))


def _start(as_of, minutes: int) -> Column:
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return as_of - F.make_dt_interval(mins=F.lit(minutes))


def _window(df: DataFrame, ts: Column, as_of, minutes: int | None, width: str) -> DataFrame:
    """[as_of - minutes, start of the bucket of as_of): the current bucket is partial."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    df = df.filter(ts < F.date_trunc(width, now))
    return df if minutes is None else df.filter(ts >= _start(as_of, minutes))


def volume_band(buckets: DataFrame, limit: int | None = 8) -> DataFrame:
    """Distribution of a producer's bucket counts: median, deviation, presence, series.

    Input is one row per (producer, bucket), so a producer's arrays are as long as the window
    has buckets, whatever the data volume.
    """
    # Both uses of the buckets ask for the same columns, so that they are counted once.
    estate = one_value(buckets, F.count_distinct(F.when(F.col("n") >= 0, F.col("t"))))
    point = F.struct(F.unix_seconds("t").alias("t"), F.col("n"))
    per = buckets.groupBy("service").agg(
        F.sort_array(F.collect_list("n")).alias("_n"), F.stddev_pop("n").alias("sd"), F.count("*").alias("seen"),
        F.max_by("n", "t").alias("latest"), F.unix_seconds(F.max("t")).alias("latest_t"),
        F.sort_array(F.collect_list(point)).alias("series"))
    # The middle of the sorted counts, then of their sorted distances from it.
    half = int_div(F.col("seen"), 2).cast("int")
    per = per.withColumn("_mid", F.get("_n", half)).withColumn(
        "_dev", F.sort_array(F.transform("_n", lambda n: F.abs(n - F.col("_mid")))))
    out = per.select(
        "service", F.col("_mid").cast("double").alias("median"), F.get("_dev", half).cast("double").alias("mad"),
        "sd", "seen", "latest", "latest_t", "series").withColumn("estate", estate)
    return _top(out, limit, F.desc("median"), "service")


def volume_board(verdicts: DataFrame) -> DataFrame:
    """Verdicts in reading order: severity, then silent producers, then size."""
    rank = V.state_rank("state")
    return verdicts.withColumn("severity", rank).orderBy(
        "severity", (F.col("absent") > 0).desc(), F.desc("median"), "service")


def volume_tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count("*").alias("producers"),
        F.count_if(F.col("state").isin(V.WARN, V.FAIL)).alias("alerting"),
        F.count_if(F.col("state") == V.UNMONITORED).alias("not_monitored"),
        F.count_if(F.col("absent") > 0).alias("silent"),
        F.count_if(F.col("estimator") == "stddev").alias("on_fallback"))


def producer_health(verdicts: DataFrame, violations: DataFrame,
                    required: int = len(C.REQUIRED_RESOURCE_KEYS)) -> DataFrame:
    """Volume verdict, silence and contract violations combined; the worst state wins."""
    v = verdicts.select("service", "state", "z", "absent", "estate", "why")
    c = violations.select("service", "violating", F.size(F.split("missing_keys", ","))
                          .alias("keys_missing"))
    both = v.join(c, "service", "full_outer")
    watched = F.col("state").isNotNull()
    silent = watched & V.is_silent()
    violating = F.coalesce(F.col("violating") > 0, F.lit(False))
    state = F.coalesce("state", F.lit(V.UNKNOWN))
    rank = F.least(V.state_rank(state), F.when(silent | violating, V.STATE_RANK[V.WARN])
                   .otherwise(V.STATE_RANK[V.PASSING]))
    worst = F.element_at(F.array(*[F.lit(s) for s in V.STATE_RANK]), rank + 1)
    reasons = F.filter(F.array(
        F.when(watched & F.col("state").isin(V.WARN, V.FAIL),
               F.concat(F.lit("volume_out_of_band z="), F.col("z").cast("string"))),
        F.when(silent, F.concat(F.lit("silent buckets="), F.col("absent").cast("string"),
                                F.lit("/"), F.col("estate").cast("string"))),
        F.when(violating, F.concat(F.lit("keys_missing rows="), F.col("violating").cast("string"),
                                   F.lit(" keys="), F.col("keys_missing").cast("string"),
                                   F.lit(f"/{required}")))),
        lambda r: r.isNotNull())
    fallback = F.when(watched, F.col("why")).otherwise(F.lit("no_volume"))
    return both.select(
        "service", worst.alias("state"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(fallback)
        .alias("why"))
