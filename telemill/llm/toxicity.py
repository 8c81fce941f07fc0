"""Toxic passages by maximum-scoring segments over token log-odds.

A token is a word of four bytes or more together with its stems, its prefixes of four to eight bytes.  Token
scores are log-odds of occurring in toxic against clean training documents with an informative Dirichlet
prior: the tokens' document counts over the whole corpus, scaled to ``PRIOR`` of the training rows.  Only tokens
enter the lexicon whose likelihood-ratio statistic stands out among all candidates.  A word scores as its best
token, every other word costs ``DRIFT``.  A linear scan (Ruzzo and Tompa) finds all maximal segments of a
document.  Segment scores are judged by the extreme-value law of maximal segment sums over clean text
(Karlin and Altschul), a document by the significance of its best sum of normalised scores, which a logistic
curve through the training rows turns into a probability.

Null and empty texts have no words and the lowest score.  Labels without a class, without ``doc_id`` or for unknown
documents are ignored; a document labelled more than once counts as toxic if any label says so.  Without toxic or
clean training rows the lexicon is empty and every score is the same and low.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from telemill.llm.logistic import calibrate, sigmoid
from telemill.llm.shared import stage, whole

#: At most about so many labelled documents are read to fit the lexicon (a sample by hash of ``doc_id``).
TRAIN_DOCS = 20_000
#: Weight of the prior against the training documents, and its least weight.
PRIOR, LEAST_PRIOR = 0.1, 10.0
#: A token of the lexicon: least log-odds, and least number of toxic training documents.
LEAST_ODDS, LEAST_DOCS = 1.5, 2
DRIFT = 0.5
#: Karlin's K; its effect is the logarithm of one factor.
K = 0.1
THRESHOLD = 0.7
#: Significance (-ln p) above which documents count alike.
CEILING = 20.0
STEMS = (4, 5, 6, 7, 8)

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def tokens_of(word: bytes) -> list[bytes]:
    """A word and, marked by a star, its stems; short words have no tokens."""
    return [word, *(word[:k] + b"*" for k in STEMS if k <= len(word))] if len(word) >= STEMS[0] else []


@dataclass(frozen=True)
class Model:
    """``scores`` of lexicon tokens; ``rate`` is lambda of the extreme-value law over clean text."""

    scores: dict[bytes, float]
    rate: float
    drift: float = DRIFT
    k: float = K
    heads: frozenset[bytes] = field(default=frozenset())
    slope: float = 1.0
    shift: float = -3.0

    def probability(self, significance: float) -> float:
        return float(sigmoid(np.float64(self.slope * min(significance, CEILING) + self.shift)))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that score, and their scores."""
        heads, n, get = self.heads, STEMS[0], self.scores.get
        at, scores = [], []
        for i, word in [(i, w) for i, w in enumerate(words) if w[:n] in heads]:
            best = max((get(t, 0.0) for t in tokens_of(word)), default=0.0)
            if best > 0:
                at.append(i)
                scores.append(best)
        return np.array(at, np.int64), np.array(scores)


def _model(scores: dict[bytes, float], rate: float) -> Model:
    return Model(scores, rate, heads=frozenset(t[:STEMS[0]] for t in scores))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """One row ``(id, toxic)`` for each labelled document, about ``most`` of them by hash."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max("toxic").alias("toxic"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a token; the words of each class stand under the empty token."""
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            own = words_of(text.as_py())
            mine = seen[1 if toxic else 0]
            for word in set(own):
                mine.update(tokens_of(word)[:1])
            mine.update({t for word in set(own) for t in tokens_of(word)[1:]})
            mine[b""] += len(own)
            mine[b"*"] += 1
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)],
            names=["token", "clean", "toxic"])


def _surprise(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """Likelihood-ratio statistic of a token's split over the classes against the classes' sizes."""
    both, n = clean + toxic, n_clean + n_toxic
    part = lambda seen, size: F.when(seen > 0, seen * F.log(seen * F.lit(n) / (both * F.lit(size)))).otherwise(F.lit(0.0))
    return (part(clean, n_clean) + part(toxic, n_toxic)) * 2


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learn the lexicon from ``labels(doc_id, toxic)``; the caller leaves held-out rows out."""
    sample = _sample(labels, most)  # at most about ``most`` rows: small enough to broadcast
    # One text for each labelled id, however often a row is repeated.
    train = docs.select(F.col("doc_id").alias("_doc"), whole().alias("_text")).join(
        F.broadcast(sample), F.col("_doc") == F.col("id")).groupBy("id", "toxic").agg(F.min("_text").alias("text")).select("text", "toxic")
    counts = stage(train.mapInArrow(_class_counts, "token binary, clean long, toxic long").groupBy("token").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tokens")
    totals = {bytes(r["token"]): r for r in counts.where(F.col("token").isin(bytearray(b""), bytearray(b"*"))).collect()}
    if b"*" not in totals or not totals[b"*"]["clean"] or not totals[b"*"]["toxic"]:
        return _model({}, 1.0)
    n_clean, n_toxic = totals[b"*"]["clean"], totals[b"*"]["toxic"]
    candidates = counts.where((F.length("token") > 1) & (F.col("toxic") >= LEAST_DOCS))
    bar = 2 * math.log(max(2, candidates.count())) + 2
    # Tokens that stand out in a bounded sample: few, and no more than the sample has.
    found = candidates.where(
        (F.col("toxic") * n_clean > F.col("clean") * n_toxic)
        & (_surprise(F.col("clean"), F.col("toxic"), n_clean, n_toxic) >= bar)).collect()
    words = {bytes(r["token"]): (r["clean"], r["toxic"]) for r in found}
    corpus, total = _corpus_counts(docs, words)
    prior = max(LEAST_PRIOR, PRIOR * (n_clean + n_toxic))
    scores = {}
    for word, (clean, toxic) in words.items():
        a = prior * corpus[word] / total
        odds = math.log((toxic + a) / max(0.5, n_toxic + prior - toxic - a)) - math.log(
            (clean + a) / max(0.5, n_clean + prior - clean - a))
        if odds >= LEAST_ODDS:
            scores[word] = odds
    tails = [((words[w][0] + 0.5) / (totals[b""]["clean"] + 1), s) for w, s in scores.items()]
    if not scores:
        return _model({}, 1.0)
    model = _model(scores, _rate(tails, DRIFT))
    return _calibrated(model, train)


def _calibrated(model: Model, train: DataFrame) -> Model:
    """The model with the logistic curve through the significances of the (bounded) training rows."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            out = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                out.append(significance(segments(*own.hits(words), own.drift), len(words), own))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(1).cast(pa.int64())], names=["x", "y"])

    rows = train.mapInArrow(run, "x double, y long").toPandas().sort_values(["x", "y"])
    # Beyond some point more significance tells nothing more.
    slope, shift = calibrate(np.minimum(rows["x"].to_numpy(), CEILING), (rows["y"].to_numpy() > 0).astype(float))
    return replace(model, slope=max(slope, 0.0), shift=shift)


def _rate(tails: list[tuple[float, float]], drift: float) -> float:
    """The positive root of ``sum p exp(rate * score) = 1`` over clean text."""
    rest = 1 - sum(p for p, _ in tails)

    def over(rate: float) -> bool:
        return sum(p * math.exp(min(rate * s, 700)) for p, s in tails) + rest * math.exp(-rate * drift) > 1

    low, high = 0.0, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(low, 0.05)


def _corpus_counts(docs: DataFrame, tokens) -> tuple[dict[bytes, int], int]:
    """How many of all documents have each token, and how many there are."""
    names = sorted(tokens)
    shared = docs.sparkSession.sparkContext.broadcast({t: i + 1 for i, t in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        heads = frozenset(t[:STEMS[0]] for t in number)
        sums = np.zeros(len(number) + 1, np.int64)
        for batch in batches:
            sums[0] += batch.num_rows
            for text in batch.column(0):
                hit = {w for w in words_of(text.as_py()) if w[:STEMS[0]] in heads}
                for i in {number.get(t, 0) for w in hit for t in tokens_of(w)} - {0}:
                    sums[i] += 1
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["i", "n"])

    sums = {r["i"]: r["n"] for r in docs.select(whole().alias("text")).mapInArrow(run, "i long, n long").groupBy(
        "i").agg(F.sum("n").alias("n")).collect()}
    return {t: sums.get(i + 1, 0) for i, t in enumerate(names)}, max(1, sums.get(0, 0))


def segments(at: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first word, word after, score)``.

    ``at`` are the positions of the words that score; every word between costs ``drift``.  Linear by
    Ruzzo and Tompa: a list of candidate segments with the sums before (``left``) and up to (``right``) each.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, before = 0.0, 0
    for place, score in zip(at.tolist(), scores.tolist()):
        total -= drift * (place - before)
        left, total = total, total + score
        before = place + 1
        own = (place, place + 1, left, total)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= own[2]:
                j -= 1
            if j < 0 or stack[j][3] >= own[3]:
                stack.append(own)
                break
            own = (stack[j][0], own[1], stack[j][2], own[3])
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


def significance(found: list[tuple[int, int, float]], n_words: int, model: Model) -> float:
    """-ln p of a document by the best sum of normalised segment scores, over any number of segments."""
    best, total = 0.0, 0.0
    for r, (_, _, score) in enumerate(sorted(found, key=lambda s: -s[2]), 1):
        total += model.rate * score - math.log(model.k * n_words + 1)
        if total <= 0:
            break
        if r == 1:
            own = total if total > 30 else -math.log(-math.expm1(-math.exp(-total)))
        else:
            own = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
        best = max(best, own)
    return best


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Rows with ``n_words``, ``toxicity`` (0 to 1) and ``passages`` (word spans with score and expected number).

    ``carry`` names the columns to keep, which may not be called like the new ones.
    """
    carry = carry or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a word of the lexicon needs training rows; these are bounded
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            n_words, scores, passages = [], [], []
            for text in batch.column("_text"):
                words = words_of(text.as_py())
                found = segments(*own.hits(words), own.drift)
                n_words.append(len(words))
                scores.append(own.probability(significance(found, len(words), own)))
                expected = [(own.k * len(words) + 1) * math.exp(-own.rate * s) for _, _, s in found]
                passages.append([{"from": a, "to": b, "score": s, "expected": e}
                                 for (a, b, s), e in zip(found, expected)])
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(scores, pa.float64()), pa.array(passages, kind)],
                names=[*(n for n in batch.schema.names if n != "_text"), "n_words", "toxicity", "passages"])

    given = docs.select(*carry, whole().alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")
    return given.mapInArrow(run, f"{fields}, n_words long, toxicity double, "
                                 "passages array<struct<`from`:long,`to`:long,score:double,expected:double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names).withColumnRenamed(names[at], "text")
    own = [n if i != at else "text" for i, n in enumerate(names)]
    return score(plain, model, carry=own).where(F.col("toxicity") < threshold).select(
        *(F.col(n).alias(old) for n, old in zip(own, docs.columns)))
