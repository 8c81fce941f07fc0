"""Column expressions shared by all layers.  All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill import contract as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def attr(attributes, key: str) -> Column:
    """Attribute value; a missing key (or a null map) reads as the empty string."""
    return F.coalesce(F.try_element_at(col(attributes), F.lit(key)), F.lit(""))


def has_key(attributes, key: str) -> Column:
    """Key presence, false on a null map.  Presence counts, not the value behind the key."""
    return F.coalesce(F.map_contains_key(col(attributes), key), F.lit(False))


def missing_any(attributes, keys) -> Column:
    """True when at least one of the keys is absent."""
    flag = F.lit(False)
    for key in keys:
        flag = flag | ~has_key(attributes, key)
    return flag


def is_true(attributes, key: str) -> Column:
    return F.lower(attr(attributes, key)) == "true"


def sorted_map(m) -> Column:
    """Same map with its entries in key order."""
    return F.map_from_entries(F.sort_array(F.map_entries(col(m))))


def map_text(m) -> Column:
    """``k=v`` pairs in key order: a comparable, hashable form of a map."""
    pairs = F.transform(F.sort_array(F.map_entries(col(m))),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(pairs, ",")


def sorted_set(c) -> Column:
    return F.sort_array(F.collect_set(col(c)))


def int_div(a, b) -> Column:
    """Integer division; keeps 64-bit exactness where ``/`` would go through double."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", col(a), b)


def ns_to_timestamp(ns) -> Column:
    """Microsecond timestamp of a nanosecond integer, rounding towards the past."""
    ns = col(ns)
    return F.timestamp_micros(int_div(ns - F.pmod(ns, F.lit(1000)), 1000))


def bucket(ts, width: str = "minute") -> Column:
    """Start of the tumbling bucket: ``minute`` by default, any ``date_trunc`` unit."""
    return F.date_trunc(width, col(ts))


def rate_of(part, whole) -> Column:
    """part / whole, 0.0 where there is nothing to divide by."""
    whole = col(whole)
    return F.when(whole > 0, col(part) / whole).otherwise(F.lit(0.0))


def is_error_log(number, text) -> Column:
    return (col(number) >= C.ERROR_SEVERITY_NUMBER) | F.upper(col(text)).isin(
        *C.ERROR_SEVERITY_TEXTS)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of re-deriving.

    Catalyst pushes a filter through a projection by copying its expressions, which for a
    parser means parsing again per reference.  A one-element ``inline`` is not copied.
    """
    return df.select("*", F.inline(F.array(F.struct(
        *[c.alias(name) for name, c in columns.items()]))))


def one_value(df: DataFrame, aggregate: Column) -> Column:
    """An aggregate of a whole table as a scalar subquery: no join, no collect."""
    return df.agg(aggregate.alias("v")).scalar()


def let(value: Column, use) -> Column:
    """Bind a value once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tenths(x: Column) -> Column:
    """Number of tenths nearest to x in [1, 10), ties to even, on the exact binary value.

    2**52 times such a number is an integer, so the comparison with the midpoint is exact.
    """
    unit = F.lit(2**52)

    def nearest(scaled: Column) -> Column:
        def settle(below: Column) -> Column:
            twice, middle = scaled * 20, (below * 2 + 1) * unit
            return (below + F.when(twice > middle, 1)
                    .when(twice == middle, F.pmod(below, F.lit(2))).otherwise(0))
        return let(int_div(scaled * 10, unit), settle)

    return let((x * float(2**52)).cast("bigint"), nearest)


def _strip(number: str, x: Column) -> Column:
    return F.regexp_replace(F.format_string(number, x), r"\.?0+$", "")


def _sig2(x: Column) -> Column:
    mag = F.abs(x)
    tenths = _tenths(F.when((mag >= 1) & (mag < 10), mag).otherwise(F.lit(1.0)))
    # Java rounds halves up; a half between two even-ended forms is all its digits, so it can be seen and cut.
    digits = F.format_string("%.16e", x)
    rounded = F.when(digits.rlike(r"^-?\d\.[02468]50+e"), F.regexp_replace(digits, r"50+e", "e")).otherwise(
        F.format_string("%.1e", x))
    science = F.regexp_replace(rounded, r"\.0e", "e")
    return (F.when(mag == 0, F.lit("0"))
            .when((mag >= 99.5) | (mag < 1e-4), science)
            .when(mag >= 10, F.bround(x, 0).cast("bigint").cast("string"))
            .when(mag >= 1, _strip("%.1f", F.signum(x) * tenths / 10.0))
            .when(mag >= 0.1, _strip("%.2f", x)).when(mag >= 0.01, _strip("%.3f", x))
            .when(mag >= 0.001, _strip("%.4f", x)).otherwise(_strip("%.5f", x)))


def sig2(x) -> Column:
    """Two significant digits, in scientific form from 100 up and below 1e-4."""
    return let(col(x).cast("double"), _sig2)
