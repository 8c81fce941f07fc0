"""Packing of token sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``length`` ids.  The histogram of piece lengths, at most ``length``
numbers, is packed on the driver: lengths from the longest, each into the packs that are emptiest so
far.  Packs with equal content are one pattern with a count, so the work depends on ``length`` alone.  The
result says, for each length, which ranks go to which sequences and offsets; pieces find theirs by rank
among the pieces of their length.  Ranks are counted within each task and shifted by the counts of the tasks
before, so no length, however common, is gathered anywhere.

Null texts count as empty; every document has at least its end id.  Rows with equal or null ``doc_id`` are
packed as separate documents.  An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from telemill.llm.shared import stage, whole
from telemill.llm.tokens import encoder, vocabulary_path

LENGTH = 4096
END_ID = 2

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long, ids binary"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])


def shortest_pack_first(counts: np.ndarray, length: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Placements ``(first rank, how many, first sequence, offset)`` by piece length.

    ``counts[l]`` is the number of pieces of length ``l``.  ``open_`` holds runs of packs with equal free room.
    """
    placed: dict[int, list[tuple[int, int, int, int]]] = {}
    open_: list[tuple[int, int, int]] = []
    sequences = 0
    for size in range(length, 0, -1):
        left, rank = int(counts[size]), 0
        own = placed.setdefault(size, []) if left else []
        while left:
            if open_ and -open_[0][0] >= size:
                room, first, many = heapq.heappop(open_)
                room = -room
            else:
                many = -(-left // (length // size))
                room, first = length, sequences
                sequences += many
            n = min(left, many)
            own.append((rank, n, first, length - room))
            if n < many:
                heapq.heappush(open_, (-room, first + n, many - n))
            if room > size:
                heapq.heappush(open_, (size - room, first, n))
            rank, left = rank + n, left - n
    return placed


def _cut(path: str, end_id: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _FIELDS}
            for doc, own in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist())):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at:at + length].tobytes()
                    size = len(piece) // 4
                    values = (doc, at, size, zlib.crc32(piece), len(ids), part, int(seen[size]),
                              piece if with_ids else None)
                    seen[size] += 1
                    for field, value in zip(_FIELDS, values):
                        out[field.name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _FIELDS], schema=_FIELDS)

    return run


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID,
         with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)`` of every piece.

    ``ids`` (little-endian 32-bit) are left out with ``with_ids=False``, for callers that keep them elsewhere.
    """
    spark = docs.sparkSession
    pieces = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(
            _cut(vocabulary or vocabulary_path(), end_id, length, with_ids), _PIECES), "pieces")
    # By task and length: how many there are, and how many in the tasks before.
    shares = pieces.groupBy("part", "length").agg(F.count("*").alias("n")).withColumn(
        "ahead", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    shares = stage(shares, "shares")
    histogram = np.zeros(length + 1, np.int64)
    for row in shares.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    placed = shortest_pack_first(histogram, length)
    del histogram
    spots = {size: np.array(rows, np.int64).T for size, rows in placed.items()}

    # A row for each task and length grows with the tasks, so it is dealt with the pieces, not broadcast.
    ranked = pieces.join(shares.select("part", "length", "ahead").hint("merge"), ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("nth") + F.col("ahead")).alias("rank"), *(["ids"] if with_ids else []))
    spots = spark.sparkContext.broadcast(spots)  # its size is a matter of ``length``

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                own = sizes == size
                first, _, head, at = spots.value[int(size)]
                k = np.searchsorted(first, ranks[own], side="right") - 1
                sequence[own] = head[k] + ranks[own] - first[k]
                offset[own] = at[k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start")), batch.column("length").cast(pa.int64()),
                 *(batch.column(c) for c in ("ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset),
                 *([batch.column("ids")] if with_ids else [])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                       *(["ids"] if with_ids else [])])

    return ranked.mapInArrow(
        find, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids binary" if with_ids else ""))
