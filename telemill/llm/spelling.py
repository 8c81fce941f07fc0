"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the frequent form each goes back to.

Of two words one edit apart the longer one (either, if equally long; L characters) gives two disjoint chunks of
q = L // 2 characters, its beginning and its end; the other gives its positional grams of q characters.  One edit leaves one
chunk whole, and moves it by at most one place, so the words meet in a join on chunk and gram within shift one.
A common chunk alone would gather far too many words: since it is whole, the edit lies in the rest, whose own beginning or
end of half its length is whole too, and the join takes that piece along.  A group then agrees in about three quarters of its
characters, which bounds its size by the alphabet, not by the number of words.  Grams that no chunk reaches within shift
one are not sent.  Candidates are verified by edit distance; a pair that meets several times counts where it meets first.

No table is broadcast: a staged file is several times smaller than its rows, and Spark does not count what an explode adds, so
it would take millions of grams for a table small enough.

Words are the maximal runs of Latin letters of whole texts, A-Z lower-cased.  Null and empty texts have none; a null id
reads as the empty text; repeated rows count again.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill.llm.shared import stage, whole

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form must be this many times as frequent as the word.
FACTOR = 10
#: A run whose hash this number divides loses a character.
SLIP = 31

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A chain of forms grows by FACTOR a link, and a count has at most 19 digits; each round doubles the reach.
_ROUNDS = 5


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: distinct words of at least :data:`MIN_LENGTH` characters and :data:`MIN_COUNT` occurrences.

    Runs whose hash is divisible by :data:`SLIP` lose one character first, as a slip of the pen would.
    """
    # A shorter run stays too short; the pattern takes runs whole, so it never starts or ends inside one.
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_d"), whole(text).alias("_t")).select(
        "_d", F.explode(F.expr(r"regexp_extract_all(_t, '[A-Za-z\\u00C0-\\u00FF]{%d,}', 0)" % MIN_LENGTH)).alias("_r")
    ).select("_d", F.translate("_r", _UPPER, _UPPER.lower()).alias("_r"))
    h = F.crc32(F.concat("_d", F.lit(":"), "_r"))
    at = (h % F.length("_r")).cast("int")
    cut = F.concat(F.expr("substring(_r, 1, _at)"), F.expr("substring(_r, _at + 2)"))
    found = runs.select("_r", h.alias("_h"), at.alias("_at")).select(
        F.when(F.col("_h") % SLIP == 0, cut).otherwise(F.col("_r")).alias("word"))
    return found.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= MIN_COUNT)


def _keys(word: str, longer: str, own: str) -> str:
    """SQL of the four join keys of a word.

    ``longer`` is the length of the longer word of the pair and ``own`` that of this one.  Keys 0 and 1 hold the
    beginning chunk, 2 and 3 the end chunk, each with the beginning or the end of the rest.
    """
    q, rest = f"({longer} DIV 2)", f"({longer} - {longer} DIV 2)"
    r = f"({rest} DIV 2)"
    head, tail = f"left({word}, {q})", f"right({word}, {q})"
    after, before = f"substring({word}, {q} + 1)", f"left({word}, {own} - {q})"
    pieces = [(head, f"left({after}, {r})"), (head, f"right({word}, {r})"),
              (tail, f"left({word}, {r})"), (tail, f"right({before}, {r})")]
    return ", ".join(f"xxhash64({longer}, {k}, {c}, {p})" for k, (c, p) in enumerate(pieces))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``(a, n, b, m)``: every pair of words exactly one inserted, deleted or replaced character apart, once.

    ``a`` is the longer word, or the smaller of two equally long ones; ``n`` and ``m`` are their counts.
    """
    base = vocabulary.select("word", "n", F.length("word").cast("int").alias("_l"))
    chunks = base.select(
        F.col("word").alias("a"), "n", F.col("_l").alias("_la"),
        F.posexplode(F.expr(f"array({_keys('word', '_l', '_l')})")).alias("_k", "_key"))
    grams = base.select("word", "n", "_l", F.explode(F.array(F.col("_l"), F.col("_l") + 1)).alias("_to")).select(
        F.col("word").alias("b"), F.col("n").alias("m"), F.col("_l").alias("_lb"),
        F.explode(F.expr(f"array({_keys('word', '_to', '_l')})")).alias("_key"))
    # Where two words share a key, the first key they share stands for the pair.
    q, r = "(_la DIV 2)", "((_la - _la DIV 2) DIV 2)"

    def prefix(n):
        return f"left(a, {n}) = left(b, {n})"

    def suffix(n):
        return f"right(a, {n}) = right(b, {n})"

    met = [prefix(f"{q} + {r}"), f"{prefix(q)} AND {suffix(r)}", f"{suffix(q)} AND {prefix(r)}", suffix(f"{q} + {r}")]
    first = "CASE " + " ".join(f"WHEN {m} THEN {k}" for k, m in enumerate(met)) + " END"
    return chunks.join(grams.hint("merge"), "_key").where(
        "(_la = _lb AND a < b OR _la = _lb + 1)").where(f"_k = {first}").where("levenshtein(a, b, 1) = 1").select("a", "n", "b", "m")


def forms(vocabulary: DataFrame) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` for every word of ``vocabulary``."""
    both = near_pairs(vocabulary).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("to"), F.col("m").alias("to_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("to"), F.col("n").alias("to_n")))).alias("_p")).select("_p.*")
    best = both.groupBy("word").agg(
        F.count("*").alias("_near"), F.min(F.struct((-F.col("to_n")).alias("n"), F.col("to").alias("to"))).alias("_best"))
    clear = -F.col("_best.n") >= FACTOR * F.col("n")
    return vocabulary.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(clear, F.col("_best.to")).alias("form"), F.when(clear, -F.col("_best.n")).cast("long").alias("form_n"))


def roots(named: DataFrame) -> DataFrame:
    """``named`` with ``root``: the end of the chain of forms that starts at the word, the word itself where it has none."""
    links = stage(named.where("form IS NOT NULL").select(F.col("word").alias("_w"), F.col("form").alias("_to")), "forms")
    for _ in range(_ROUNDS):
        # Many words may share a form, so its own link is looked up once and the few forms that move are joined back.
        moves = links.select("_to").distinct().join(
            links.select(F.col("_w").alias("_to"), F.col("_to").alias("_next")).hint("merge"), "_to")
        moves = stage(moves, "moves")
        if moves.isEmpty():
            break
        links = stage(links.join(moves.hint("merge"), "_to", "left").select("_w", F.coalesce("_next", "_to").alias("_to")), "forms")
    return named.join(links.hint("merge"), F.col("word") == F.col("_w"), "left").select(
        *named.columns, F.coalesce("_to", "word").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """Every word with its near words, form and root."""
    vocabulary = stage(words(docs), "words")
    return roots(stage(forms(vocabulary), "near-words"))
