"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of class 1.  Unlabelled web text is every document: each step sums its risk and
gradient over all of them, in whole numbers, so that the order of rows and tasks does not matter.  A linear
scorer minimises ``prior * R_p+ + max(0, R_u- - prior * R_p-)`` with the logistic loss; a step whose second term
falls below 0 is stepped back (Kiryo et al.).  The class prior is the share of class 1 among the labelled training
rows, all of them.  A last one-dimensional logistic fit on the training labels turns margins into probabilities.

Features look at form only: frequencies of trigrams over 16 character classes, and bins of a few ratios (letters,
distinct words, words repeated at once, mean word length, length).  Null and empty texts have the features of an
empty text.  Without training rows of both classes every score is the prior (0.5 if there are no labels).
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from telemill.llm.logistic import calibrate, sigmoid
from telemill.llm.shared import stage, whole

#: At most about so many labelled rows are drawn by hash to fit the scorer.
LABELLED_ROWS = 8_000
#: Steps over all documents, and the first step's size.
STEPS = 30
RATE = 0.2
#: Parts of one in sums over documents.
_UNIT = float(1 << 24)
THRESHOLD = 0.3
EPOCHS = 40
BATCH = 512

_CLASSES = ["", "\n\r", ".", ",", "!", "?", "|", "%&#*$@^~+=<>", "'\"`", "()[]{}", "-_/\\:;", "0123456789"]
_UPPER, _LOWER, _BLANK, _HIGH = 12, 13, 14, 15
_TABLE = bytes(
    _HIGH if b >= 128 else _UPPER if 65 <= b <= 90 else _LOWER if 97 <= b <= 122 else
    _BLANK if b in (32, 9) else next((i for i, c in enumerate(_CLASSES) if chr(b) in c), 0) for b in range(256))
_GRAMS = 16 ** 3
_BINS = 12
_RATIOS = 6
SIZE = _GRAMS + _RATIOS * _BINS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; the squares of the trigram values sum to 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.frombuffer(raw.translate(_TABLE), np.uint8)
    index, value = np.zeros(0, np.int64), np.zeros(0)
    if len(kinds) >= 3:
        codes = (kinds[:-2].astype(np.uint16) << 8) | (kinds[1:-1].astype(np.uint16) << 4) | kinds[2:]
        counts = np.bincount(codes, minlength=_GRAMS)
        index = np.nonzero(counts)[0]
        value = np.sqrt(counts[index] / len(codes))
    words = raw.split()
    n, m = max(1, len(words)), max(1, len(kinds))
    share = np.bincount(kinds, minlength=16) / m
    ratios = [share[_UPPER], share[_LOWER] + share[_HIGH], len(set(words)) / n,
              sum(map(operator.eq, words, words[1:])) / n, min(1.0, len(raw) / n / 20), min(1.0, np.log1p(n) / 12)]
    bins = [_GRAMS + i * _BINS + min(_BINS - 1, int(r * _BINS)) for i, r in enumerate(ratios)]
    return np.concatenate([index, np.array(bins)]), np.concatenate([value, np.ones(_RATIOS)])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, index: np.ndarray, value: np.ndarray) -> float:
        margin = float(self.weights[index] @ value) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


class Rows:
    """Sparse rows, one after another."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.index = [np.asarray(i, np.int64) for i, _ in rows]
        self.value = [np.asarray(v, np.float64) for _, v in rows]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(self.index[i]) for i in at]
        return (np.repeat(np.arange(len(at)), sizes), np.concatenate([self.index[i] for i in at]),
                np.concatenate([self.value[i] for i in at]))

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.array([weights[i] @ v for i, v in zip(self.index, self.value)]) + bias

    def __len__(self) -> int:
        return len(self.index)


def train(positive: Rows, unlabelled: Rows, prior: float, epochs: int = EPOCHS, batch: int = BATCH,
          rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over batches of both sets."""
    draw = np.random.default_rng(seed)
    w, m, s = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    step = 0
    for _ in range(epochs):
        order_u = draw.permutation(len(unlabelled))
        order_p = np.resize(draw.permutation(len(positive)), max(len(positive), len(unlabelled)))
        for a in range(0, len(order_u), batch):
            at_u, at_p = order_u[a:a + batch], order_p[a:a + batch]
            grads, risks = [], []
            for rows, at in ((positive, at_p), (unlabelled, at_u)):
                r, i, v = rows.take(at)
                z = np.bincount(r, w[i] * v, len(at)) + w[-1]
                p = sigmoid(z)
                risks.append((np.logaddexp(0, -z).mean(), np.logaddexp(0, z).mean()))
                own = []
                for slope in (p - 1, p):  # of the loss as class 1, and as class 0
                    g = np.bincount(i, (slope / len(at))[r] * v, SIZE + 1)
                    g[-1] += slope.mean()
                    own.append(g)
                grads.append(own)
            negative = risks[1][1] - prior * risks[0][1]
            g_negative = grads[1][1] - prior * grads[0][1]
            g = prior * grads[0][0] + g_negative if negative >= 0 else -g_negative
            g += decay * w
            step += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def _sums(index: np.ndarray, value: np.ndarray, row: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """``SIZE + 3`` sums in units over ``n`` rows: gradient of the loss as class 0, bias last, that loss, and ``n`` itself."""
    z = np.bincount(row, w[index] * value, n) + w[-1]
    p = sigmoid(z)
    out = np.zeros(SIZE + 3)
    out[:SIZE] = np.bincount(index, np.rint(p[row] * value * _UNIT), SIZE)
    out[SIZE] = np.rint(p * _UNIT).sum()
    out[SIZE + 1] = np.rint(np.logaddexp(0, z) * _UNIT).sum()
    out[SIZE + 2] = n
    return out


def unlabelled_sums(featured: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Mean gradient and risk of all rows as class 0, and how many there are."""
    shared = featured.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 3, np.int64)
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            total += _sums(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy().astype(np.float64),
                           np.repeat(np.arange(len(sizes)), sizes), len(sizes), shared.value).astype(np.int64)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "part"])

    rows = featured.select("index", "value").mapInArrow(run, "at int, part long").groupBy("at").agg(
        F.sum("part").alias("total")).collect()  # as many rows as there are features
    shared.unpersist()
    total = np.zeros(SIZE + 3)
    for r in rows:
        total[r["at"]] = r["total"]
    n = int(total[-1])
    return total[:SIZE + 1] / _UNIT / max(1, n), float(total[SIZE + 1]) / _UNIT / max(1, n), n


def descend(positive: Rows, featured: DataFrame, prior: float, steps: int = STEPS, rate: float = RATE,
            decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """As ``train``, in full steps over every row of ``featured``."""
    w, m, s = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    r, i, v = positive.take(np.arange(len(positive)))
    n = len(positive)
    for step in range(1, steps + 1):
        p = sigmoid(np.bincount(r, w[i] * v, n) + w[-1])
        as_zero = np.logaddexp(0, np.bincount(r, w[i] * v, n) + w[-1]).mean()
        own = []
        for slope in (p - 1, p):
            g = np.bincount(i, (slope / n)[r] * v, SIZE + 1)
            g[-1] += slope.mean()
            own.append(g)
        g_all, risk, _ = unlabelled_sums(featured, w)
        g_negative = g_all - prior * own[1]
        g = prior * own[0] + g_negative if risk - prior * as_zero >= 0 else -g_negative
        g += decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        size = rate * (1 - 0.9 * (step - 1) / steps)
        w = w - size * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _featured(df: DataFrame) -> DataFrame:
    """``(label, index, value)`` of rows ``(text, label)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
                names=["label", "index", "value"])

    return df.mapInArrow(run, "label int, index array<int>, value array<float>")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS) -> Model:
    """Fit from ``labels(doc_id, quality)``, of which the caller leaves held-out rows out, and from all of ``docs``."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.min("quality").cast("int").alias("label"))
    seen = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not seen["n"] or seen["ones"] in (0, seen["n"]):
        prior = float(np.clip((seen["ones"] or 0) / seen["n"], 0.01, 0.99)) if seen["n"] else 0.5
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    prior = seen["ones"] / seen["n"]

    def drawn(column: str, n: int, most: int, salt: int) -> Column:
        share = min(1.0, most / max(1, n))
        return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(1 << 20)) < int((1 << 20) * share)

    sample = F.broadcast(rows.where(drawn("id", seen["n"], labelled, 1)))  # bounded by ``labelled``
    # One text for each labelled id, however often a row is repeated.
    known = _featured(docs.select(F.col("doc_id").alias("_doc"), whole().alias("_text")).join(
        sample, F.col("_doc") == F.col("id")).groupBy("id", "label").agg(F.min("_text").alias("text")).select("text", "label")).toPandas()

    def ordered(frame) -> Rows:  # whatever order the tasks came in
        rows = [(np.asarray(i, np.int32), np.asarray(v, np.float32)) for i, v in zip(frame["index"], frame["value"])]
        return Rows(sorted(rows, key=lambda r: (len(r[0]), r[1].tobytes(), r[0].tobytes())))

    ones, zeros = ordered(known[known["label"] == 1]), ordered(known[known["label"] == 0])
    if not len(ones) or not len(zeros):
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    everything = stage(_featured(docs.select(whole().alias("text"), F.lit(None).cast("int").alias("label"))), "features")
    weights, bias = descend(ones, everything, prior)
    margins = np.concatenate([ones.margins(weights, bias), zeros.margins(weights, bias)])
    slope, shift = calibrate(margins, np.repeat([1, 0], [len(ones), len(zeros)]))
    return Model(weights, bias, slope, shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row; higher is better."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many weights as there are features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.probability(*features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(
        run, "doc_id long, score double")
