"""SimHash near-duplicates by anchor-point covering.

A fingerprint's two 32-bit halves are covered separately: two fingerprints that differ in at most
``2 r + 1`` bits have a half that differs in at most ``r``.  The anchors of a half are a covering code, two
Hamming [15, 11] codes side by side and two free bits, with covering radius 2.  Each half is copied to
every anchor within the covering radius plus ``r``: the nearest anchor of one member of a close pair is at
most that far from the other, so the two meet there, and only members of one anchor are compared.

Equal fingerprints are one member.  Anchors with many members are dealt to several tasks as pairs of
blocks.  From each anchor only the links of a spanning forest leave, so a dense cluster costs its
size in rows and not its square.

Null texts count as empty, an empty text has fingerprint zero, repeated rows are equal members of one
group, rows without ``doc_id`` keep their fingerprint and have no component (null).  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from telemill.llm.components import components
from telemill.llm.shared import partitions, stage, whole

DISTANCE = 3
RADIUS = 2
#: Members of one anchor compared by one task; more are dealt out as pairs of blocks of this size.
BLOCK = 4096
#: Anchors with at most this many members are compared together, without a loop for each.
SMALL = 24


# -- fingerprints -------------------------------------------------------------


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; words are split at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a:a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (simhash(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(
        run, "doc_id long, fp long")


# -- anchors ------------------------------------------------------------------


def _syndromes(weight: int) -> dict[int, list[int]]:
    """Error patterns of up to ``weight`` bits of the Hamming [15, 11] code, by syndrome.

    Bit ``i`` has column ``i + 1`` of the check matrix, so a pattern's syndrome is the XOR of these.
    """
    out: dict[int, list[int]] = {s: [] for s in range(16)}
    for w in range(weight + 1):
        for bits in combinations(range(15), w):
            s = pattern = 0
            for i in bits:
                s ^= i + 1
                pattern |= 1 << i
            out[s].append(pattern)
    return out


def anchor_table(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 256 syndrome pairs: where its masks start, how many there are, and all masks.

    A mask XORed to a half with these syndromes gives an anchor at most ``reach`` bits away; nearest first.
    """
    patterns = _syndromes(reach)
    free = [0, 1 << 30, 1 << 31, 3 << 30]
    masks, starts, sizes = [], [], []
    for low in range(16):
        for high in range(16):
            own = [a | (b << 15) | c for a in patterns[low] for b in patterns[high] for c in free]
            own = sorted((m for m in own if m.bit_count() <= reach), key=lambda m: (m.bit_count(), m))
            starts.append(len(masks))
            sizes.append(len(own))
            masks += own
    return np.array(starts), np.array(sizes), np.array(masks, np.uint64)


def _syndrome_lookup() -> np.ndarray:
    value = np.arange(1 << 15)
    out = np.zeros(1 << 15, np.int64)
    for i in range(15):
        out ^= np.where(value >> i & 1, i + 1, 0)
    return out


def anchors_of(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor key, nearest)`` of every copy; the key's lowest bit says which half."""
    starts, sizes, masks = anchor_table(reach)
    lookup = _syndrome_lookup()
    rows, keys, nearest = [], [], []
    for half in (0, 1):
        value = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        low = lookup[(value & np.uint64(0x7FFF)).astype(np.int64)]
        high = lookup[((value >> np.uint64(15)) & np.uint64(0x7FFF)).astype(np.int64)]
        kind = low * 16 + high
        n = sizes[kind]
        row = np.repeat(np.arange(len(fps)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        anchor = value[row] ^ masks[starts[kind][row] + nth]
        rows.append(row)
        keys.append((anchor << np.uint64(1)) | np.uint64(half))
        nearest.append(nth == 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(nearest)


# -- links within an anchor ---------------------------------------------------


def _forest(fps: np.ndarray, nodes: np.ndarray, side: np.ndarray | None, distance: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of one group: each member is reached once, from the first that is close.

    ``side`` holds block numbers 1 and 2 of a pair of blocks; a link between any two is right all the same.
    """
    left = np.arange(len(fps))
    while len(left):
        queue = [left[0]]
        left = left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            if close.any():
                for other in left[close]:
                    yield int(nodes[at]), int(nodes[other])
                queue.extend(left[close])
                left = left[~close]


def _few(fps, nodes, nearest, first, sizes, distance) -> tuple[np.ndarray, np.ndarray]:
    """All links of many small groups at once, each with a member at its nearest anchor."""
    a = np.repeat(first, sizes)
    within = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    me = a + within
    rest = np.repeat(sizes, sizes) - within - 1
    x = np.repeat(me, rest)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(rest) - rest, rest)
    ok = (nearest[x] | nearest[y]) & (np.bitwise_count(fps[x] ^ fps[y]) <= distance)
    return nodes[x[ok]], nodes[y[ok]]


def _links(distance: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def compare(frame: pd.DataFrame) -> pd.DataFrame:
            key, part = frame["anchor"].to_numpy(), frame["part"].to_numpy()
            fps, nodes = frame["fp"].to_numpy().view(np.uint64), frame["node"].to_numpy()
            nearest = frame["nearest"].to_numpy().astype(bool)
            cut = np.nonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])[0]
            sizes = np.diff(np.r_[cut, len(key)])
            some = (sizes > 1) & (sizes <= SMALL)
            out = [np.stack(_few(fps, nodes, nearest, cut[some], sizes[some], distance), axis=1)]
            for c, n in zip(cut[sizes > SMALL], sizes[sizes > SMALL]):
                found = list(_forest(fps[c:c + n], nodes[c:c + n], None, distance))
                if found:
                    out.append(np.array(found, np.int64))
            both = np.concatenate(out)
            return pd.DataFrame({"a": both.min(1), "b": both.max(1)}).drop_duplicates() if len(both) else (
                pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}))

        for frame in frames:
            if not len(frame):
                continue
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = (frame["anchor"] == frame["anchor"].iloc[-1]) & (frame["part"] == frame["part"].iloc[-1])
            rest, frame = frame[last], frame[~last]
            if len(frame):
                yield compare(frame)
        if rest is not None:
            yield compare(rest)

    return run


def close_links(members: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``members(node, fp)`` that keep all connections at ``distance`` bits.

    Fingerprints must be distinct.  An anchor with more than ``block`` members is dealt out as pairs of
    blocks, each a unit of its own, so one dense anchor is shared by many tasks.
    """
    spark = members.sparkSession
    reach = RADIUS + distance // 2

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = frame["fp"].to_numpy().view(np.uint64)
            row, key, nearest = anchors_of(fps, reach)
            yield pd.DataFrame({
                "anchor": key.view(np.int64), "node": frame["node"].to_numpy()[row],
                "fp": fps.view(np.int64)[row], "nearest": nearest})

    copies = members.select("node", "fp").mapInPandas(
        spread, "anchor long, node long, fp long, nearest boolean")
    # Crowded anchors are few: counts are summed before the shuffle and only those above the block stay.
    crowded = stage(copies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block), "crowded")
    if crowded.isEmpty():
        dealt = copies.withColumn("part", F.lit(0))
    else:
        blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: (
            F.least(own, other) * 65536 + F.greatest(own, other)))
        dealt = copies.join(crowded, "anchor", "left").withColumn(
            "part", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("n")
    found = dealt.repartition(partitions(spark), "anchor", "part").sortWithinPartitions(
        "anchor", "part").select("anchor", "part", "node", "fp", "nearest").mapInPandas(
        _links(distance), "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component is the smallest ``doc_id`` reachable."""
    made = stage(fingerprints(docs, width, seed), "simhash")
    members = stage(
        made.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "members")
    groups = components(close_links(members, distance))
    named = members.join(groups, "node", "left").select(
        F.col("fp").alias("member_fp"), F.coalesce("component", "node").alias("component"))
    return made.join(named, F.col("fp") == F.col("member_fp"), "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` of which ``doc_id`` names its component, and rows without id.

    Rows that agree in ``doc_id`` and text are one; different texts of one id all stay with it.
    """
    heads = near_duplicates(docs.select("doc_id", "text"), distance).where("doc_id = component_id").select(
        F.col("doc_id").alias("_head")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*names)
    kept = plain.where(F.col(key).isNotNull()).join(heads, F.col(key) == F.col("_head"), "left_semi")
    return kept.dropDuplicates([key, text]).unionByName(plain.where(F.col(key).isNull())).toDF(*docs.columns)


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
