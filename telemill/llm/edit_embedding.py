"""Document fingerprints by a randomised edit embedding.

A walk over the characters of a text writes the character it stands on and then, by a random bit shared by all
texts for that step and character, stays or moves on.  Walks of two texts that meet stay together until the next
difference, so edit distance becomes Hamming distance between what they write (Chakraborty, Goldenberg, Koucky).
A character here is a hash of ``GRAM`` code points.  The fingerprint keeps the written characters, four bits each,
at fixed random steps: a few for each octave of steps, so texts of any length are sampled whole and comparable.

``likeness`` of two fingerprints is the share of equal samples, each octave weighted by its length and corrected for
chance.

Null texts count as empty; an empty text has an empty fingerprint, which is like another empty one alone.  Repeated rows
get equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from telemill.llm.shared import partitions, whole

GRAM = 4
SEED = 20240501
#: Steps of the first octave; samples of an octave below ``LONG`` steps, and of the first and the longer ones.
FIRST, LONG = 64, 512
FEW, MANY = 8, 32
OCTAVES = 40
_PERIOD = 8191
#: With fewer texts under way a plain loop is faster than lockstep.
_LOOP = 32
#: Code points walked in lockstep at a time.
GROUP = 8 << 20


def _walk_bits() -> np.ndarray:
    bits = np.random.default_rng(SEED).integers(0, 2, (_PERIOD, 256), dtype=np.uint8)
    bits[:, 0] = 0  # the end of a text
    return bits


def octave_samples(octave: int) -> np.ndarray:
    """Sampled steps of an octave, ascending."""
    low = 0 if octave == 0 else FIRST << (octave - 1)
    size = FIRST if octave == 0 else low
    n = FEW if 0 < octave and size < LONG else MANY
    draw = np.random.default_rng((SEED, octave))
    return low + (np.sort(draw.choice(size, n, replace=False)) if size <= 1 << 20 else np.sort(draw.integers(0, size, n)))


class Walker:
    """Walks many texts in lockstep."""

    def __init__(self):
        self.bits = _walk_bits()
        self.raw = self.bits.tobytes()
        self.steps: list[int] = []
        for o in range(OCTAVES):
            self.steps += octave_samples(o).tolist()
        self.ends = np.cumsum([len(octave_samples(o)) for o in range(OCTAVES)])

    @staticmethod
    def letters(text: str) -> np.ndarray:
        """A byte from 1 to 255 for each code point and the ``GRAM - 1`` after it, and a final 0."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        mixed = codes * np.uint32(0x9E3779B1)
        for k in range(1, GRAM):
            mixed[:-k] = (mixed[:-k] ^ (codes[k:] * np.uint32(0x85EBCA6B + 2 * k))) * np.uint32(0xC2B2AE35) if k < len(codes) else mixed[:-k]
        out = np.zeros(len(codes) + 1, np.uint8)
        out[:-1] = 1 + ((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(8)) % np.uint32(255)
        return out

    def fingerprints(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        held = 0
        for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
            if texts[k]:
                group.append(k)
                held += len(texts[k])
            if held >= GROUP:
                self._walk(texts, group, out)
                group, held = [], 0
        if group:
            self._walk(texts, group, out)
        return out

    def _walk(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        own = [self.letters(texts[k]) for k in group]
        flat = np.concatenate(own)
        sizes = np.array([len(x) for x in own])
        place = np.cumsum(sizes) - sizes
        last = place + sizes - 1
        found = np.zeros((len(group), len(self.steps)), np.uint8)
        live, step, k = np.arange(len(group)), 0, 0
        while len(live) > _LOOP:
            at = place[live]
            for step in range(step, step + 256):
                letter = flat[at]
                if step == self.steps[k]:
                    found[live, k] = letter
                    k += 1
                at += self.bits[step % _PERIOD][letter]
            step += 1
            place[live] = at
            live = live[at < last[live]]
        for r in live.tolist():
            self._finish(own[r].tobytes(), int(place[r] - (last[r] - sizes[r] + 1)), step, k, found[r])
        nibbles = np.where(found > 0, 1 + found % 15, 0).astype(np.uint8)
        for r, k in enumerate(group):
            used = np.nonzero(nibbles[r])[0]
            octave = int(np.searchsorted(self.ends, used[-1], side="right")) if len(used) else 0
            mine = nibbles[r, :self.ends[octave]]
            out[k] = (mine[0::2] << 4 | mine[1::2]).tobytes()

    def _finish(self, letters: bytes, i: int, step: int, k: int, found: np.ndarray) -> None:
        raw, n, period = self.raw, len(letters) - 1, _PERIOD
        while i < n:
            until = self.steps[k]
            for step in range(step, until):
                i += raw[(step % period) << 8 | letters[i]]
            step = until
            found[k] = letters[i]
            k += 1


_WALKER: list[Walker] = []


def walker() -> Walker:
    if not _WALKER:
        _WALKER.append(Walker())
    return _WALKER[0]


def _samples(fingerprint: bytes) -> np.ndarray:
    both = np.frombuffer(fingerprint, np.uint8)
    return np.stack([both >> 4, both & 15], 1).ravel()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = _samples(a), _samples(b)
    n = max(len(x), len(y))
    x, y = np.pad(x, (0, n - len(x))), np.pad(y, (0, n - len(y)))
    ends = walker().ends
    octaves = int(np.searchsorted(ends, n)) + 1
    sizes = np.diff(np.r_[0, ends[:octaves]])
    weight = np.repeat([(FIRST if o == 0 else FIRST << (o - 1)) / s for o, s in zip(range(octaves), sizes)], sizes)[:n]
    some = (x > 0) | (y > 0)
    total = float(weight[some].sum())
    if not total:
        return 0.0
    same = float(weight[some & (x == y)].sum()) / total
    return max(0.0, (same - 1 / 15) / (14 / 15))


# -- documents and their edits ------------------------------------------------


def _in_buckets(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of ``doc_id``; a range's first rows also go, as ``extra``, to the range before it.

    Bounds are quantiles of the ids and heads a row for each range, so the driver sees a few numbers per task.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    bounds = sorted(set(docs.approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    if bounds:
        splits = [-float("inf"), *bounds, float("inf")]
        docs = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(docs)
    else:
        docs = docs.withColumn("range", F.lit(0))
    dealt = docs.drop("at").withColumn("range", F.col("range").cast("int"))
    heads = [(r["range"], r["head"]) for r in dealt.groupBy("range").agg(F.min("doc_id").alias("head")).orderBy(
        "range").collect()]
    if not heads:
        return dealt.withColumn("extra", F.lit(False))
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    small = spark.createDataFrame(before, "head long, before int")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("extra")),
                F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))))
    return dealt.join(F.broadcast(small), F.col("doc_id") == F.col("head"), "left").select(
        "doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.range", "p.extra")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64())])
_OUT_SQL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def edited(text: str, follower: str) -> str:
    """The last quarter of a text replaced by as much of another's beginning, or all of it."""
    n = len(text) // 4
    return text[:len(text) - n] + follower[:n]


def _judge(names: list[int | None], texts: list[str], prints: list[bytes], with_next: bool) -> pa.RecordBatch:
    """Results of all rows but the last, which is the follower of the one before."""
    walk = walker()
    n = len(texts) - 1
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    theirs = walk.fingerprints(changed)
    columns = [names[:n], [len(t) for t in texts[:n]],
               [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
               [p.hex() for p in prints[:n]], [p.hex() for p in theirs],
               [likeness(a, b) for a, b in zip(prints, theirs)],
               [likeness(a, b) if with_next else None for a, b in zip(prints, prints[1:])]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: list = []
    texts: list[str] = []
    extras: list[bool] = []
    prints: list[bytes] = []
    for batch in batches:
        new = batch.column("text").to_pylist()
        names += batch.column("doc_id").to_pylist()
        extras += batch.column("extra").to_pylist()
        texts += new
        prints += walker().fingerprints(new)
        out = _judge(names, texts, prints, True)
        yield out.filter(pa.array([not e for e in extras[:-1]]))
        names, texts, extras, prints = names[-1:], texts[-1:], extras[-1:], prints[-1:]


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            yield _judge([name, None], [text, ""], walker().fingerprints([text]) + [b""], False)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's beginning, by ascending ``doc_id``.

    Rows of equal id follow each other by text.  A row without ``doc_id`` has no next document: its edit only
    loses the last quarter, and ``near_next`` is null.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    known = given.where("doc_id is not null").withColumn("at", F.col("doc_id").cast("double"))
    spark = docs.sparkSession
    ordered = _in_buckets(known).repartition(partitions(spark), "range").sortWithinPartitions(
        "range", "extra", "doc_id", "text")
    chained = ordered.select("doc_id", "text", "extra").mapInArrow(_chained, _OUT_SQL)
    return chained.union(given.where("doc_id is null").mapInArrow(_alone, _OUT_SQL))
