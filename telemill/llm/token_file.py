"""Token-id files: documents in ``doc_id`` order as static-rANS blocks under one shared table.

A file set is a folder with two Parquet tables.  ``table`` has a row for each id that occurs, with its slots of
``2 ** 20``.  ``segments`` has a row for each run of consecutive documents: where it starts among all ids, its
documents with their counts of ids, and its blocks (see ``rans``).  A segment holds about ``SEGMENT`` ids, or
one longer document, and every segment, block and checkpoint can be decoded by itself.

Null texts count as empty; every document ends with the end id, so none has zero ids.  Rows without
``doc_id`` come first, repeated ids are ordered by text, repeated rows are all written.  An empty table makes
a file set without segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill.llm import rans
from telemill.llm.shared import partitions, stage, whole
from telemill.llm.tokens import encoder, vocabulary_path

END_ID = 1
SEGMENT = 1 << 20

_STAGED = "part int, nth int, ahead long, doc_ids array<long>, counts array<long>, ids binary"
_STORED = "start long, n_tokens long, doc_ids array<long>, counts array<long>, blocks array<binary>"


def _record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _segments(path: str, end_id: int, size: int):
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("ahead", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(path), TaskContext.get().partitionId()
        nth = ahead = held = 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            return _record(schema, part=[part], nth=[nth], ahead=[ahead], doc_ids=[docs],
                           counts=[[len(x) for x in ids]], ids=[np.concatenate(ids).astype("<u2" if small else "<u4").tobytes()])

        small = tokens.vocabulary_size <= 1 << 16
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, own in zip(names, tokens.encode(batch.column(1).to_pylist())):
                docs.append(name)
                ids.append(np.append(own, np.uint32(end_id)))
                held += len(own) + 1
                if held >= size:
                    yield close()
                    nth, ahead, held, docs, ids = nth + 1, ahead + held, 0, [], []
        if docs:
            yield close()

    return run


def _ids(data: bytes, counts: list[int]) -> np.ndarray:
    """Ids as they were staged, in two or four bytes each."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * sum(counts) else "<u4").astype(np.uint32)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID,
          segment: int = SEGMENT) -> None:
    """Encode every text of ``docs(doc_id, text)`` and write the file set to ``path``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).repartitionByRange(
        partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    staged = stage(ordered.mapInArrow(_segments(vocabulary, end_id, segment), _STAGED), "segments")
    del ordered

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.bincount(_ids(data, counts), minlength=len(total))
                own[:len(total)] += total
                total = own
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    # As many rows as the vocabulary has ids, whatever the corpus.
    counted = staged.select("counts", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    freqs = rans.Table.of_counts(counts).freqs.astype(np.int64)
    spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(freqs) if f], "id long, slots long").coalesce(
        1).write.parquet(f"{path}/table")

    # One row for each partition of the sort.
    sizes = staged.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias(
        "n")).orderBy("part").collect()
    offsets, at = {}, 0
    for row in sizes:
        offsets[row["part"]] = at
        at += row["n"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freqs)
        schema = pa.schema([("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("counts", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary()))])
        for batch in batches:
            for row in batch.to_pylist():
                ids = _ids(row["ids"], row["counts"])
                yield _record(schema, start=[offsets[row["part"]] + row["ahead"]], n_tokens=[len(ids)],
                              doc_ids=[row["doc_ids"]], counts=[row["counts"]], blocks=[rans.encode(ids, table)])

    staged.mapInArrow(pack, _STORED).write.option("compression", "none").parquet(f"{path}/segments")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document of a file set; ``ids`` are little-endian 32-bit."""
    return _decoded(spark, path, lambda ids: ids.astype("<u4").tobytes(), pa.binary(), "ids binary")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``: every id is decoded, only the checksum leaves the task."""
    return _decoded(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32 long")


def _decoded(spark: SparkSession, path: str, of, kind: pa.DataType, column: str) -> DataFrame:
    slots = spark.read.parquet(f"{path}/table").toPandas()
    freqs = np.zeros(int(slots["id"].max()) + 1 if len(slots) else 1, np.int64)
    freqs[slots["id"].to_numpy(np.int64)] = slots["slots"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freqs)
        for batch in batches:
            for row in batch.to_pylist():
                ids = rans.decode(row["blocks"], table)
                sizes = np.array(row["counts"], np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != row["n_tokens"] or int(ends[-1]) != len(ids):
                    raise ValueError("a segment's documents do not fill it")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), pa.array(sizes),
                     pa.array([of(ids[e - n:e]) for e, n in zip(ends, sizes)], kind)],
                    names=["doc_id", "start", "n_tokens", column.split()[0]])

    return spark.read.schema(_STORED).parquet(f"{path}/segments").mapInArrow(
        run, f"doc_id long, start long, n_tokens long, {column}")
