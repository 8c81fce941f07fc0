"""Volume verdicts as column expressions over the statistics of a volume band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill import contract as C

# States are fixed values; reasons are codes, followed by the numbers they rest on.
FAIL, WARN, PASSING = "fail", "warn", "passing"
UNMONITORED, UNKNOWN = "unmonitored", "unknown"
NO_DISPERSION = "flat_series"
NO_BAND = "band_misses_own_window"
STATE_RANK = {FAIL: 0, WARN: 1, UNMONITORED: 2, UNKNOWN: 3, PASSING: 4}


def oob_share(series, centre, scale) -> Column:
    """Share of the points ``(t, n)`` outside centre ± 3 scale; 0 for an empty series."""
    series, centre, scale = (F.col(c) if isinstance(c, str) else c
                             for c in (series, centre, scale))
    lo, hi = centre - C.Z_WARN * scale, centre + C.Z_WARN * scale
    outside = F.size(F.filter(series, lambda p: (p["n"] < lo) | (p["n"] > hi)))
    return F.when(F.size(series) > 0, outside / F.size(series)).otherwise(F.lit(0.0))


def state_rank(state) -> Column:
    state = F.col(state) if isinstance(state, str) else state
    rank = F.lit(len(STATE_RANK))
    for name, value in STATE_RANK.items():
        rank = F.when(state == name, F.lit(value)).otherwise(rank)
    return rank


def volume_state(band: DataFrame) -> DataFrame:
    """Band, estimator and verdict per producer.

    The median absolute deviation is tried first, then the standard deviation; an estimator
    only counts when the band it gives contains its own window.
    """
    mad_scale = F.col("mad") * C.MAD_TO_SIGMA
    out = (
        band.withColumn("absent", F.greatest(F.lit(0), F.col("estate") - F.col("seen")))
        .withColumn("_mad_share", oob_share("series", "median", mad_scale))
        .withColumn("_sd_share", oob_share("series", "median", "sd"))
    )
    enough = F.col("estate") >= C.MIN_BUCKETS
    use_mad = enough & (mad_scale > 0) & (F.col("_mad_share") <= C.MAX_OOB_SHARE)
    use_sd = enough & ~use_mad & (F.col("sd") > 0) & (F.col("_sd_share") <= C.MAX_OOB_SHARE)
    out = out.withColumn(
        "estimator",
        F.when(use_mad, F.lit("mad")).when(use_sd, F.lit("stddev")).otherwise(F.lit("none")))
    fits = F.col("estimator") != "none"
    out = out.withColumn("_scale", F.when(F.col("estimator") == "mad", mad_scale)
                         .when(F.col("estimator") == "stddev", F.col("sd")))
    out = out.withColumn("_z", F.when(fits, F.abs(F.col("latest") - F.col("median"))
                                      / F.col("_scale")))
    share = F.when(F.col("estimator") == "mad", F.col("_mad_share")).when(
        F.col("estimator") == "stddev", F.col("_sd_share"))
    reach = C.Z_WARN * F.col("_scale")
    return out.select(
        *band.columns, "absent", "estimator",
        F.coalesce(F.round("_scale", 2), F.lit(0.0)).alias("scale"),
        F.when(fits, F.round(F.col("median") - reach, 1)).otherwise(F.col("median")).alias("lo"),
        F.when(fits, F.round(F.col("median") + reach, 1)).otherwise(F.col("median")).alias("hi"),
        F.coalesce(F.round("_z", 2), F.lit(0.0)).alias("z"),
        F.round(share, 3).alias("oob"),
        F.when(~fits, F.lit(UNMONITORED)).when(F.col("_z") >= C.Z_ERROR, F.lit(FAIL))
        .when(F.col("_z") >= C.Z_WARN, F.lit(WARN)).otherwise(F.lit(PASSING)).alias("state"),
        F.when(~enough, F.concat(F.lit("too_few_buckets n="), F.col("estate").cast("string")))
        .when(fits, F.format_string("distance z=%.1f median=%.0f", F.col("_z"), F.col("median").cast("double")))
        .when((F.col("mad") <= 0) & (F.col("sd") <= 0), F.lit(NO_DISPERSION))
        .otherwise(F.lit(NO_BAND)).alias("why"))


def out_of_band_points(verdicts: DataFrame) -> DataFrame:
    """Every bucket the published band would have alerted on, not only the latest."""
    outside = F.filter("series", lambda p: (p["n"] < F.col("lo")) | (p["n"] > F.col("hi")))
    return (verdicts.filter(F.col("state") != UNMONITORED)
            .select("service", "lo", "hi", F.explode(outside).alias("p"))
            .select("service", "lo", "hi", F.col("p.t").alias("t"), F.col("p.n").alias("n")))


def is_silent() -> Column:
    """Silence has to be material: at least two buckets and a tenth of the estate."""
    return (F.col("absent") >= C.ABSENT_MIN) & (
        F.col("absent") >= F.col("estate") * C.ABSENT_SHARE)
