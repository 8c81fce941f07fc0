"""Quality rules as a learned decision list, in SQL functions only.

Statistics of every whole text come from string and array functions.  Labelled rows that pass the base rules are cut
into bins per statistic; sequential covering then grows one conjunction of thresholds after another on two thirds of
them (best FOIL gain first), prunes its tail on the last third, and keeps it while it is precise.  Each step is one
aggregate over all labelled rows with a row for each statistic, bin and class as its result.  The list is
handed out as one ordered Spark conditional.

Null and empty texts have no words and fail the base rules.  Repeated rows are judged one by one; a document with several
labels counts once for each.  Null ids and null labels are not learned from.  Without labels, or where no
rule is precise, the list is empty and the base rules decide alone.  Extra columns of the input are ignored or kept as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from telemill.llm.shared import stage, whole

MIN_WORDS = 50
#: Quantiles of each class that serve as thresholds of a statistic.
CUTS = 24
MAX_TERMS = 4
MAX_RULES = 12
#: Least share of junk among the labelled rows that a rule takes.
PRECISION = 0.9

#: Statistics that rules may test, as expressions over the columns of :func:`statistics`.
STATISTICS = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "repeated_line_share": "n_dup_lines / greatest(_n_lines, 1)",
    "repeated_word_share": "n_repeat_words / n_words",
    "distinct_word_share": "_n_distinct / n_words",
    "words_per_line": "n_words / greatest(_n_lines, 1)",
    "capital_share": "_n_capitals / word_chars",
    "exclamations_per_word": "_n_exclaim / n_words",
    "stops_per_word": "_n_stops / n_words",
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(pattern: str) -> str:
    return f"CAST(length(_m) - length(regexp_replace(_m, '{pattern}', '')) AS BIGINT)"


def statistics(docs: DataFrame, keep: list[str] = ["doc_id"], text: str = "text") -> DataFrame:
    """Columns ``keep``, the counts :data:`BASE`, ``base_failed``, and ``_s``: the statistics as a struct of doubles.

    Words in repeated three-word windows are counted without leaving the row: window hashes cut to make room for
    the position are sorted as plain numbers, neighbours that agree are compared word by word, and the
    places of those that are equal are laid over each other.
    """
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    k = [f"_k{i}" for i in range(len(keep))]
    counts = ["_n_capitals", "_n_exclaim", "_n_stops", "_n_lines", "n_symbols", "n_dup_lines", "word_chars"]
    # SQL literals halve backslashes, so patterns double them.
    out = docs.select(*own, whole(text).alias("_t")).selectExpr(
        *k, r"array_remove(split(_t, '[\\x20\\x09-\\x0D]+'), '') AS _w",
        r"regexp_replace(_t, '[^\\p{Lu}!.#*$%&|<>]+', '') AS _m",
        r"filter(split(_t, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]') AS _l")
    out = out.selectExpr(
        *k, "_w", "size(_w) AS _n", "CAST(length(array_join(_w, '')) AS BIGINT) AS word_chars",
        _count(r"\\p{Lu}+") + " AS _n_capitals", _count("!+") + " AS _n_exclaim", _count("[.]+") + " AS _n_stops",
        _count("[#*$%&|<>]+") + " AS n_symbols",
        "CAST(size(_l) AS BIGINT) AS _n_lines", "CAST(size(_l) - size(array_distinct(_l)) AS BIGINT) AS n_dup_lines")
    out = out.selectExpr(
        *k, *counts, "_n", "_w", "length(bin(_n)) AS _b", "CAST(size(array_distinct(_w)) AS BIGINT) AS _n_distinct")
    out = out.selectExpr(*k, *counts, "_n_distinct", "_n", "_w", "_b", """
        sort_array(transform(IF(_n < 3, CAST(array() AS array<int>), sequence(0, _n - 3)),
                   i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _b) | i)) AS _p""")
    # `get` of index -1 or past the end is null, and null is not equal to anything.
    out = out.selectExpr(*k, *counts, "_n_distinct", "_n", """
        sort_array(transform(
            filter(_p, (x, j) -> coalesce(shiftrightunsigned(x, _b) = shiftrightunsigned(get(_p, j - 1), _b), false)
                              OR coalesce(shiftrightunsigned(x, _b) = shiftrightunsigned(get(_p, j + 1), _b), false)),
            x -> named_struct('a', _w[CAST(x & (shiftleft(1L, _b) - 1) AS INT)],
                              'b', _w[CAST((x & (shiftleft(1L, _b) - 1)) + 1 AS INT)],
                              'c', _w[CAST((x & (shiftleft(1L, _b) - 1)) + 2 AS INT)],
                              'i', CAST(x & (shiftleft(1L, _b) - 1) AS INT)))) AS _e""")
    out = out.selectExpr(*k, *counts, "_n_distinct", "_n", """
        sort_array(transform(
            filter(_e, (x, j) ->
                coalesce(x.a = get(_e, j - 1).a AND x.b = get(_e, j - 1).b AND x.c = get(_e, j - 1).c, false)
                OR coalesce(x.a = get(_e, j + 1).a AND x.b = get(_e, j + 1).b AND x.c = get(_e, j + 1).c, false)),
            x -> x.i)) AS _r""")
    out = out.selectExpr(*k, *counts, "_n_distinct", "CAST(_n AS BIGINT) AS n_words", """
        aggregate(transform(_r, (x, j) -> least(3, coalesce(get(_r, j + 1) - x, 3))), 0L, (s, x) -> s + x) AS n_repeat_words""")
    out = out.withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"))
    values = ", ".join(f"'{name}', coalesce(CAST({e} AS DOUBLE), 0D)" for name, e in
                       ((n, e.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ word_chars", "/ nullif(word_chars, 0)"))
                        for n, e in STATISTICS.items()))
    return out.select(
        *(F.col(a).alias(b) for a, b in zip(k, keep)), *BASE, "base_failed", F.expr(f"named_struct({values})").alias("_s"))


@dataclass(frozen=True)
class Term:
    """``statistic >= cut`` or ``statistic < cut``."""

    statistic: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col("_s")[self.statistic]
        return value >= self.cut if self.above else value < self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Term, ...]


def _all(terms: Rule) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & t.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional: the number of the first rule that takes a row, from 1, else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = (F if out is None else out).when(_all(rule), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each statistic: quantiles of either class."""
    at = F.array(*(F.lit((i + 0.5) / CUTS) for i in range(CUTS)))
    found = rows.groupBy("_junk").agg(*(
        F.percentile_approx(F.col("_s")[name], at, F.lit(100_000)).alias(name) for name in STATISTICS)).collect()
    return {name: sorted({v for r in found for v in (r[name] or [])}) for name in STATISTICS}


def _tally(rows: DataFrame, points: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """For each statistic the counts of good and junk rows in each bin; bin k holds values from cut k-1 up to cut k."""
    named = list(points)
    cells = rows.select("_junk", F.posexplode("_bins").alias("_at", "_bin")).groupBy("_at", "_bin", "_junk").count().collect()
    out = {name: [[0] * (len(points[name]) + 1) for _ in range(2)] for name in named}
    for c in cells:
        out[named[c["_at"]]][int(c["_junk"])][c["_bin"]] += c["count"]
    return out


def _best(tally: dict[str, list[list[int]]], points: dict[str, list[float]]) -> tuple[Term, float, int] | None:
    """The term of greatest FOIL gain, with the good rows it leaves; ties go to the first statistic and the lowest cut."""
    best = None
    for name, (good, junk) in tally.items():
        n0, p0 = sum(good), sum(junk)
        if not p0 or not n0:
            return None
        low_n = low_p = 0
        for k, cut in enumerate(points[name]):
            low_n, low_p = low_n + good[k], low_p + junk[k]
            for above, n, p in ((True, n0 - low_n, p0 - low_p), (False, low_n, low_p)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > 1e-9 and (best is None or gain > best[1] + 1e-9):
                        best = Term(name, above, cut), gain, n
    return best


def _prefixes(rows: DataFrame, terms: Rule) -> list[list[tuple[int, int]]]:
    """Junk and good rows that each beginning of ``terms`` takes, among the rows to prune on and among all."""
    sums = []
    for k in range(1, len(terms) + 1):
        for part in (~F.col("_grow"), F.lit(True)):
            for junk in (F.col("_junk"), ~F.col("_junk")):
                sums.append(F.coalesce(F.sum((_all(terms[:k]) & part & junk).cast("long")), F.lit(0)).alias(f"v{len(sums)}"))
    row = rows.agg(*sums).first()
    return [[(row[4 * k], row[4 * k + 1]), (row[4 * k + 2], row[4 * k + 3])] for k in range(len(terms))]


def _up_to(value: Column):
    return lambda cut: cut <= value


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules from rows with ``_s``, ``_junk`` (boolean) and ``_grow`` (boolean: grow on it, else prune on it)."""
    points = cuts(labelled)
    bins = F.array(*(
        F.size(F.filter(F.array(*map(F.lit, points[n])), _up_to(F.col("_s")[n]))) if points[n] else F.lit(0)
        for n in STATISTICS))
    rows = stage(labelled.select("_s", "_junk", "_grow", bins.alias("_bins")), "labelled-statistics")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = rows.where(verdict(rules) == 0)
        terms: Rule = ()
        while len(terms) < MAX_TERMS:
            found = _best(_tally(left.where(F.col("_grow") & _all(terms)), points), points)
            if found is None:
                break
            terms += (found[0],)
            if not found[2]:
                break
        if not terms:
            break
        taken = _prefixes(left, terms)
        worth = [(p - n) / (p + n) if p + n else -1.0 for (p, n), _ in taken]
        keep = max(range(len(terms)), key=lambda k: (worth[k], -k))
        (held, _), (p, n) = taken[keep]
        if not held or p < PRECISION * (p + n):
            break
        rules.append(terms[:keep + 1])
    return rules


def fit(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn from ``labels`` (doc_id, quality) over :func:`statistics`; the third to prune on is drawn by a hash of the id."""
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_junk"))
    rows = stats.where("NOT base_failed").join(named, F.col("doc_id") == F.col("_id")).select(
        "_s", "_junk", (F.pmod(F.xxhash64("_id"), F.lit(3)) != 0).alias("_grow"))
    return learn(rows)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``rule`` (the first that takes the row, 0: none) and ``kept``."""
    return stats.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
