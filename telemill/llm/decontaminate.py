"""Benchmark decontamination with suffix arrays of the training documents.

Every task turns its documents, shard by shard, into word ids and a suffix array over them.  Every suffix
of every benchmark item is then searched in the array by binary search.  That gives the range of
training suffixes that start with an item's window, so all verbatim occurrences, and beside the range
the longest match.  Words outside the benchmark's vocabulary share one id that matches nothing and their suffixes
are left out of the array.

The benchmark is a stated query set: it is read in blocks of bounded size, each block is broadcast by
itself, and the documents pass block after block in one narrow chain, without a shuffle.

A null or wordless text has no words and no hits; an item without words matches nothing; items with equal
``item_id`` count once and a null ``item_id`` is listed as the empty text.  Repeated rows are judged one by
one, and columns beside ``doc_id`` and ``text`` pass through ``keep_clean`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

WINDOW = 13
#: Words of benchmark items in one block, and of documents in one shard.
BLOCK_WORDS = 1 << 20
SHARD_WORDS = 1 << 20
#: Share of hit words at which a document is contaminated, as 1 / SHARE.
SHARE = 20

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; a word is a run of ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with ``ids > 0`` in the order of their suffixes, compared over ``depth`` ids at least.

    Prefix doubling; only positions whose rank is still shared are sorted again.  Ids of 0 end a text.
    """
    n = len(ids)
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = ids
    order = np.nonzero(ids)[0]
    order = order[np.argsort(rank[order], kind="stable")]
    head = np.ones(len(order), bool)
    head[1:] = rank[order[1:]] != rank[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) + 1
    size = 1
    while size < depth and len(order):
        shared = ~head
        shared[:-1] |= ~head[1:]
        at = np.nonzero(shared)[0]
        if not len(at):
            break
        own = order[at]
        follow = rank[np.minimum(own + size, n)]
        by = np.lexsort((follow, rank[own]))
        own, follow = own[by], follow[by]
        first = rank[own]
        new = np.ones(len(own), bool)
        new[1:] = (first[1:] != first[:-1]) | (follow[1:] != follow[:-1])
        order[at], head[at] = own, new
        rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))] + 1
        size *= 2
    return order


class Block:
    """Some benchmark items as word ids, with a suffix for every word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted(set(chain.from_iterable(w for _, w in items))))}
        self.ids = np.fromiter((self.vocabulary[x] for _, w in items for x in [*w, None] if x is not None), np.int64)
        sizes = np.array([len(w) for _, w in items], np.int64)
        ends = np.cumsum(sizes)
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.item = np.repeat([number[name] for name, _ in items], sizes).astype(np.int64)
        self.left = np.repeat(ends, sizes) - np.arange(len(self.ids))
        self.place = np.arange(len(self.ids)) - np.repeat(ends - sizes, sizes)
        # Where a window starts, and how long it is.
        whole_item = np.repeat(sizes, sizes)
        self.width = np.where(whole_item >= window, window, whole_item)
        self.starts = np.nonzero(self.left >= self.width)[0]
        self.longest = int(sizes.max()) if len(sizes) else 0
        self.shortest = int(self.width.min()) if len(self.width) else 0


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark as blocks; one block at a time is held on the driver."""
    items, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").orderBy(
        "item_id")
    for row in rows.toLocalIterator():
        own = words_of(row["text"])
        if own:
            items.append((row["item_id"], own))
            held += len(own)
        if held >= block_words:
            yield Block(items, window)
            items, held = [], 0
    if items:
        yield Block(items, window)


def _compare(shard: np.ndarray, at: np.ndarray, block: Block, probe: np.ndarray, width: np.ndarray) -> tuple:
    """Sign of (shard suffix - item suffix) over ``width`` ids, and how many ids are equal."""
    n = len(probe)
    sign, equal = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)
    step = 16
    done = 0
    while len(live):
        span = np.arange(done, done + step)
        inside = span < width[live, None]
        mine = shard[np.minimum(at[live, None] + span, len(shard) - 1)]
        theirs = block.ids[np.minimum(probe[live, None] + span, len(block.ids) - 1)]
        differ = inside & (mine != theirs)
        hit = differ.any(1)
        k = np.where(hit, differ.argmax(1), inside.sum(1))
        equal[live] += k
        rows = np.nonzero(hit)[0]
        sign[live[rows]] = np.sign(mine[rows, k[rows]] - theirs[rows, k[rows]])
        live = live[~hit & inside.all(1)]
        done += step
    return sign, equal


def _lower(shard, order, block, probe, width, after: bool) -> np.ndarray:
    """Binary search of every probe: the first suffix not below it, or with ``after`` the first above its prefix."""
    low, high = np.zeros(len(probe), np.int64), np.full(len(probe), len(order), np.int64)
    while True:
        live = np.nonzero(low < high)[0]
        if not len(live):
            return low
        mid = (low[live] + high[live]) // 2
        sign, _ = _compare(shard, order[mid], block, probe[live], width[live])
        down = (sign <= 0) if after else (sign < 0)
        low[live] = np.where(down, mid + 1, low[live])
        high[live] = np.where(down, high[live], mid)


class Shard:
    """The suffix array of some documents against one block."""

    def __init__(self, texts: list[list[bytes]], block: Block):
        get = block.vocabulary.get
        sizes = np.array([len(w) + 1 for w in texts], np.int64)
        self.ids = np.fromiter((get(w, 0) for own in texts for w in chain(own, (b"",))), np.int64, int(sizes.sum()))
        self.starts = np.cumsum(sizes) - sizes
        self.order = suffix_array(self.ids, block.longest)
        self.block = block

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of windows: positions in the shard, and the block suffix each starts with."""
        probe = self.block.starts
        width = self.block.width[probe]
        first = _lower(self.ids, self.order, self.block, probe, width, False)
        last = first.copy()
        some = np.nonzero(first < len(self.order))[0]
        if len(some):  # most windows occur nowhere
            _, equal = _compare(self.ids, self.order[first[some]], self.block, probe[some], width[some])
            some = some[equal == width[some]]
            last[some] = _lower(self.ids, self.order, self.block, probe[some], width[some], True)
        n = last - first
        at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.order[at], np.repeat(probe, n)

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every block suffix: the length of its longest match in the shard and one place of it."""
        probe = np.arange(len(self.block.ids))
        if not len(self.order):
            return probe, np.zeros(len(probe), np.int64), np.zeros(len(probe), np.int64)
        width = self.block.left
        at = _lower(self.ids, self.order, self.block, probe, width, False)
        best, where = np.zeros(len(probe), np.int64), np.zeros(len(probe), np.int64)
        for side in (at - 1, at):
            ok = np.nonzero((side >= 0) & (side < len(self.order)))[0]
            _, equal = _compare(self.ids, self.order[side[ok]], self.block, probe[ok], width[ok])
            better = ok[equal > best[ok]]
            where[better] = self.order[side[better]]
            best[ok] = np.maximum(best[ok], equal)
        return probe, best, where


def _runs(frame: list[list[bytes]], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` words."""
    a = held = 0
    for b, own in enumerate(frame):
        held += len(own)
        if held >= size:
            yield a, b + 1
            a, held = b + 1, 0
    if a < len(frame):
        yield a, len(frame)


def _spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
             shard_words: int = SHARD_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with ``n_words``, ``hits`` (word spans ``from``, ``to`` covered by windows) and ``items``.

    ``carry`` names the columns to keep, ``doc_id`` alone by default; they may not be called like the new ones.
    """
    spark = docs.sparkSession
    carry = carry or ["doc_id"]
    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    added = [("n_words", T.LongType()), ("hits", span), ("items", T.ArrayType(T.StringType()))]
    text = "text" if "text" in carry else "_text"
    state = docs.select(*carry, *([] if text == "text" else [F.col("text").alias("_text")]),
                        F.lit(0).cast("long").alias("n_words"), F.array().cast(span).alias("hits"),
                        F.array().cast("array<string>").alias("items"))
    arrow_span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            for batch in batches:
                split = [words_of(t.as_py()) for t in batch.column(text)]
                hits = [[(s["from"], s["to"]) for s in row] for row in batch.column("hits").to_pylist()]
                items = [set(row) for row in batch.column("items").to_pylist()]
                for a, b in _runs(split, shard_words):
                    shard = Shard(split[a:b], block)
                    at, probe = shard.windows()
                    doc = np.searchsorted(shard.starts, at, side="right") - 1
                    for d, p, q in zip((doc + a).tolist(), (at - shard.starts[doc]).tolist(), probe.tolist()):
                        hits[d].append((p, p + int(block.width[q])))
                        items[d].add(block.names[block.item[q]])
                columns = dict(zip(batch.schema.names, batch.columns))
                columns["n_words"] = pa.array([len(w) for w in split], pa.int64())
                columns["hits"] = pa.array(
                    [[{"from": x, "to": y} for x, y in _spans(own)] for own in hits], arrow_span)
                columns["items"] = pa.array([sorted(own) for own in items], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return run

    schema = state.schema
    seen = False
    for block in blocks_of(benchmark, window, block_words):
        state, seen = state.mapInArrow(step(spark.sparkContext.broadcast(block)), schema), True
    if not seen:  # no items: only the words are counted
        state = state.mapInArrow(step(spark.sparkContext.broadcast(Block([], window))), schema)
    return state.select(*carry, *(name for name, _ in added))


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def contaminated(share: int = SHARE) -> Column:
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names).withColumn("text", F.col(names[at])).drop(names[at])
    own = [n if i != at else "text" for i, n in enumerate(names)]
    return overlaps(plain, benchmark, window, carry=own).where(~contaminated(share)).select(
        *(F.col(n).alias(old) for n, old in zip(own, docs.columns)))


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS,
                    shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(item_id, place, length, doc_id, doc_place)``: each item suffix's longest match in the corpus and where.

    Only matches of at least one word are listed.  Of equally long ones the smallest ``(doc_id, doc_place)`` stays
    among those at the edges of the shards' ranges.
    """
    spark = docs.sparkSession

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            for batch in batches:
                split = [words_of(t.as_py()) for t in batch.column(1)]
                names = batch.column(0).to_pylist()
                for a, b in _runs(split, shard_words):
                    shard = Shard(split[a:b], block)
                    probe, best, where = shard.longest()
                    some = np.nonzero(best)[0]
                    doc = np.searchsorted(shard.starts, where[some], side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.names[i] for i in block.item[probe[some]]], pa.string()),
                         pa.array(block.place[probe[some]]), pa.array(best[some]),
                         pa.array([names[a + d] for d in doc], pa.int64()),
                         pa.array(where[some] - shard.starts[doc])],
                        names=["item_id", "place", "length", "doc_id", "doc_place"])

        return run

    out = None
    for block in blocks_of(benchmark, WINDOW, block_words):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            step(spark.sparkContext.broadcast(block)),
            "item_id string, place long, length long, doc_id long, doc_place long")
        best = found.groupBy("item_id", "place").agg(
            F.max(F.struct("length", -F.coalesce("doc_id", F.lit(0)), -F.col("doc_place"), "doc_id", "doc_place")).alias("m"))
        best = best.select("item_id", "place", "m.length", "m.doc_id", "m.doc_place")
        out = best if out is None else out.union(best)
    return out if out is not None else spark.createDataFrame(
        [], "item_id string, place long, length long, doc_id long, doc_place long")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
