"""Removal of byte strings that occur in an earlier document, by merged Burrows-Wheeler transforms.

Every string of ``LENGTH`` bytes has an anchor, its least hashed ``GRAM``-gram, so equal strings share their anchor.
Anchors that occur in one text only cannot lie in a repeat and are dropped.  Around the others the texts are cut into
snippets, one for each run of string starts with the same anchor, and dealt by anchor.  A task takes the snippets of
some anchors, builds the transform of each shard of them, and merges the transforms by refining the interleave of
their suffixes one character at a time (Holt and McMillan), without sorting all suffixes again.  After round k
suffixes lie in one block just if their first k characters agree, so the rounds give the common prefixes, and the
blocks of the last round are the repeated strings; the smallest ``doc_id`` in a block owns it.

Anchors of more than ``CROWD`` texts would make large groups: their equal snippets are gathered before the shuffle, and
the strings of different ones are compared one by one, by an aggregate and a join that splits hot keys.

Equal texts are one text with the smallest ``doc_id``; of a later copy all bytes go.  A null text is empty, a null
``doc_id`` is smaller than any other, rows with the same ``doc_id`` do not remove each other.  An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from telemill.llm.shared import partitions, release, stage, whole

LENGTH = 50
GRAM = 16
CROWD = 20_000
#: Bytes of snippets merged together, and in one shard.
GROUP, SHARD = 1 << 16, 1 << 14
#: Rows of snippets looked at together, and ranges of their pieces that are compared.
ROWS, PIECES = 1 << 15, 7

_FIRST = -(1 << 63)


# -- anchors ------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each position."""
    hashes = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    size, factor = 1, 0xD6E8FEB86659FD93
    while size < gram:
        mixed = hashes ^ (hashes >> np.uint64(29))
        hashes = mixed[:-size] * np.uint64(factor) + mixed[size:]
        factor = factor * 0x2545F4914F6CDD1D % (1 << 64) | 1
        size *= 2
    return hashes * np.uint64(0xBF58476D1CE4E5B9)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[:size - width], values[width - size:])


def anchor_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(text, anchor, first start, number of starts, anchor's place)`` of every run of strings with one anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = _gram_hashes(data, gram)
    low = np.uint64(0xFFFFF)
    placed = (hashes & ~low) | (np.arange(len(hashes), dtype=np.uint64) & low)
    width = length - gram + 1
    least = _least(placed, width)
    # The low bits start anew at every 2^20 bytes.  Strings across such a place are looked at again with places of their
    # own, so that of equal grams the first one wins wherever the string stands.
    for edge in range(1 << 20, len(hashes), 1 << 20):
        first, last = max(0, edge - width + 1), min(edge, len(least))
        if first < last:
            own = (hashes[first:last + width - 1] & ~low) | np.arange(last - first + width - 1, dtype=np.uint64)
            found = _least(own, width)
            least[first:last] = (found & ~low) | ((found & low) + np.uint64(first) & low)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[:len(least)]
    ok = np.arange(len(least)) + length <= ends[text]
    at = np.nonzero(ok)[0]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    value, own = least[at], text[at]
    cut = np.nonzero(np.r_[True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])])[0]
    count = np.diff(np.r_[cut, len(at)])
    # The place's low bits stand in the value; it lies less than a string's length after the start.
    place = ((value[cut] & low).astype(np.int64) - at[cut]) % (1 << 20)
    return own[cut], (value[cut] >> np.uint64(20)).astype(np.int64), at[cut] - (ends - sizes)[own[cut]], count, place


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, anchor, start, count, place = anchor_runs(
                [t.as_py() for t in batch.column("data")], length, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), batch.column("version").take(pa.array(text)), pa.array(start.astype(np.int32)),
                 pa.array(count.astype(np.int16)), pa.array(place.astype(np.int16))],
                names=["anchor", "version", "start", "count", "place"])

    return run


# -- transforms and their merge -----------------------------------------------


def transform(snippets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and text of some strings, each with an end mark smaller than any byte.

    Characters are bytes plus 1, end marks 0 and ordered by string.  Positions are those in the joined strings
    with their marks.  The Burrows-Wheeler transform is what stands before each suffix in this order.
    """
    sizes = np.array([len(s) for s in snippets], np.int64)
    text = np.zeros(int(sizes.sum()) + len(snippets), np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(snippets), np.uint8).astype(np.uint16) + 1
    left = np.repeat(ends, sizes + 1) - np.arange(len(text))  # characters before the mark
    n, size = len(text), 7
    padded = np.concatenate([text, np.zeros(size, np.uint16)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = (key << np.uint64(9)) | np.where(k < left, padded[k:k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    longest = int(sizes.max()) + 1 if len(sizes) else 0
    head = np.r_[True, key[order[1:]] != key[order[:-1]]]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    while size < longest:
        shared = ~head
        shared[:-1] |= ~head[1:]
        at = np.nonzero(shared)[0]
        at = at[left[order[at]] >= size]  # shorter ones are equal to their marks: they stay in order of strings
        if not len(at):
            break
        own = order[at]
        follow = rank[own + size]
        by = np.lexsort((follow, rank[own]))
        own, follow = own[by], follow[by]
        first = rank[own]
        new = np.r_[True, (first[1:] != first[:-1]) | (follow[1:] != follow[:-1])]
        order[at], head[at] = own, new
        rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))] + 1
        size *= 2
    return order, text


def merge(orders: list[np.ndarray], texts: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms, refined until suffixes are ordered by ``rounds`` characters.

    Returns, for the suffixes of all shards one shard after another, their places in the merged order, and for
    each place its block: suffixes of one block agree in ``rounds`` characters.  Each step goes back over two
    characters at once where the shards' alphabet allows it.  A string with an end mark in it is alone in its block,
    so the order among such strings is of no account.
    """
    symbols = np.unique(np.concatenate(texts))
    two = len(symbols) ** 2 <= 1 << 16 and rounds % 2 == 0
    flat = []
    for order, text in zip(orders, texts):
        code = np.searchsorted(symbols, text).astype(np.uint32)
        ends = np.nonzero(text == 0)[0]
        begin = np.concatenate([[0], ends[:-1] + 1])
        back = np.concatenate([[0], np.arange(len(text) - 1)])
        back[begin] = ends  # before a string's beginning stands its own mark
        pair = code[back[back]] * np.uint32(len(symbols)) + code[back] if two else code[back]
        flat.append(pair[order].astype(np.uint16))
    flat = np.concatenate(flat)
    # The characters in order are the same in every round, and so are the places where they change or hold a mark.
    by = np.sort(flat, kind="stable")
    alone = (by % len(symbols) == 0) | (by < len(symbols)) if two else by == 0
    fixed = alone.copy()
    fixed[0] = True
    fixed[1:] |= (by[1:] != by[:-1]) | alone[:-1]
    shard = np.repeat(np.arange(len(texts)), [len(t) for t in texts]).astype(np.uint8 if len(texts) <= 256 else np.uint16)
    block = np.zeros(len(flat), np.int32)
    char = np.empty(len(flat), np.uint16)
    for _ in range(rounds // 2 if two else rounds):
        char[np.argsort(shard, kind="stable")] = flat
        order = np.argsort(char, kind="stable")
        shard, was = shard[order], block[order]
        new = fixed.copy()
        new[1:] |= was[1:] != was[:-1]
        block = np.cumsum(new, dtype=np.int32)
    return np.argsort(shard, kind="stable"), block


def earlier(snippets: list[bytes], counts: np.ndarray, owners: np.ndarray, length: int, shard: int) -> list[np.ndarray]:
    """For each snippet and each of its ``counts`` starts, the smallest owner of the same ``length`` bytes."""
    shards, held = [[]], 0
    for i, s in enumerate(snippets):
        if held >= shard:
            shards.append([])
            held = 0
        shards[-1].append(i)
        held += len(s)
    made = [transform([snippets[i] for i in own]) for own in shards]
    places, block = merge([order for order, _ in made], [text for _, text in made], length)
    shift = np.cumsum([0, *(len(text) for _, text in made)])
    base = int(shift[-1])
    suffix = np.empty(base, np.int64)
    suffix[places] = np.concatenate([order + at for (order, _), at in zip(made, shift)])  # in merged order
    sizes = np.array([len(s) + 1 for s in snippets], np.int64)
    begin = np.cumsum(sizes) - sizes
    within = np.arange(base) - np.repeat(begin, sizes)
    owner = np.where(within < np.repeat(counts, sizes), np.repeat(owners, sizes), np.iinfo(np.int64).max)[suffix]
    first = np.minimum.reduceat(owner, np.nonzero(np.r_[True, block[1:] != block[:-1]])[0])
    least = np.empty(base, np.int64)
    least[suffix] = first[block - block[0]]
    return [least[b:b + c] for b, c in zip(begin.tolist(), counts.tolist())]


def _spans(least: list[np.ndarray], kind: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose string has a smaller owner: ``(row, first, after the last)`` for rows ``(kind, doc)``."""
    sizes = np.array([len(x) for x in least], np.int64)
    flat = np.concatenate([*least, [0]])
    begin = np.cumsum(sizes) - sizes
    own = sizes[kind] + 1  # one more place parts the rows
    ends = np.cumsum(own)
    row = np.repeat(np.arange(len(kind)), own)
    within = np.arange(int(ends[-1])) - (ends - own)[row]
    inside = within < sizes[kind][row]
    flags = inside & (flat[np.where(inside, begin[kind][row] + within, len(flat) - 1)] < doc[row])
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8)]))
    first, after = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return row[first], within[first], within[first] + after - first


def _meets(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, anchor: np.ndarray,
           length: int, gram: int) -> np.ndarray:
    """Whether each of some different snippets can share a string with another one of its anchor.

    Of the bytes that a string has beside the anchor some number stands to the left.  The numbers are parted into
    ``PIECES`` ranges: snippets that share a string with a number in a range share the piece from its least number of bytes to
    the left to what the greatest leaves to the right.  Pieces are compared by hashes, so some may seem to be shared.
    """
    beside = length - gram
    bounds = np.linspace(0, beside + 1, PIECES + 1).astype(int)
    met = np.zeros(len(begin), bool)
    for left, after in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        right = beside - after + 1
        at = np.nonzero((place >= left) & (place + gram + right <= size))[0]
        hashes = anchor[at].astype(np.uint64)
        first = begin[at] + place[at] - left
        for k in range(left + gram + right):
            hashes = (hashes ^ data[first + k]) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        met[at[order[1:][same]]] = True
        met[at[order[:-1][same]]] = True
    return met


def _merged(length: int, gram: int, group: int, shard: int):
    schema = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])

    def batch_of(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Spans of the rows of whole anchors: equal snippets are one kind; what cannot meet another is settled at once.

        Of a kind's rows all but those of the smallest id are copies of that id's, so only these go to the merge.
        """
        anchor, doc, version, start, place = (rows.column(c).to_numpy() for c in ("anchor", "doc", "version", "start", "place"))
        coded = rows.column("snippet").cast(pa.large_binary()).combine_chunks().dictionary_encode()
        code, kinds = coded.indices.to_numpy(), coded.dictionary
        offsets = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset:kinds.offset + len(kinds) + 1]
        begin, size = offsets[:-1], np.diff(offsets)
        owner = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(owner, code, doc)
        copy = np.nonzero(owner[code] < doc)[0]
        yield batch_of(doc[copy], version[copy], start[copy], start[copy] + size[code[copy]])
        first = np.empty(len(kinds), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]  # a kind's first row; kinds are in order of their anchors
        by = anchor[first]
        several = np.r_[False, by[1:] == by[:-1]]
        several[:-1] |= several[1:]
        some = np.nonzero(several)[0]
        met = some[_meets(np.frombuffer(kinds.buffers()[2], np.uint8), begin[some], size[some], place[first][some],
                          by[some], length, gram)] if len(some) else some
        if not len(met):
            return
        name = np.full(len(kinds), -1)
        name[met] = np.arange(len(met))
        own = np.nonzero((name[code] >= 0) & (owner[code] == doc))[0]
        kind = name[code[own]]
        # Some anchors at a time: those that begin in the same ``group`` bytes.
        head = np.r_[True, by[met][1:] != by[met][:-1]]
        ahead = np.maximum.accumulate(np.where(head, np.cumsum(size[met]) - size[met], 0)) // group
        cuts = np.nonzero(np.r_[True, ahead[1:] != ahead[:-1]])[0].tolist()
        snippets, owners = kinds.take(pa.array(met)).to_pylist(), owner[met]
        counts = size[met] - length + 1
        for low, high in zip(cuts, [*cuts[1:], len(met)]):
            least = earlier(snippets[low:high], counts[low:high], owners[low:high], length, shard)
            at = own[(kind >= low) & (kind < high)]
            row, since, after = _spans(least, name[code[at]] - low, doc[at])
            yield batch_of(doc[at][row], version[at][row], start[at][row] + since, start[at][row] + after - 1 + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        held, wanted = 0, ROWS
        for batch in batches:
            rows.append(batch)
            held += len(batch)
            if held >= wanted:
                table = pa.Table.from_batches(rows)
                anchors = table.column("anchor").to_numpy()
                whole_ones = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
                if whole_ones:
                    yield from close(table.slice(0, whole_ones))
                rows = table.slice(whole_ones).to_batches()
                held = table.num_rows - whole_ones
                wanted = held + ROWS
        if held:
            yield from close(pa.Table.from_batches(rows))

    return run


def _spread(length: int):
    """Spans of the rows ``own`` of a snippet: all of it for copies, the strings at ``places`` for the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own, least, places, size in zip(*(batch.column(c).to_pylist() for c in ("own", "least", "places", "size"))):
                for r in own:
                    if r["doc"] > least:
                        spans.append((r["doc"], r["version"], r["start"], r["start"] + size))
                    else:
                        spans += [(r["doc"], r["version"], r["start"] + p, r["start"] + p + length) for p in places or []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*spans) if spans else [[]] * 4)],
                                             names=["doc", "version", "from", "to"])

    return run


# -- documents ----------------------------------------------------------------


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), F.encode(whole(), "UTF-8").alias("data"),
        F.xxhash64(whole(), F.lit(1)).alias("version"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``(doc, version, from, to)``: byte spans of strings that occur in another text of a smaller id.

    ``version`` is a hash of the text; of equal texts only the one with the smallest id is looked at.
    """
    spark = docs.sparkSession
    texts = _bytes(docs)
    found = texts.where(F.octet_length("data") >= length).select("data", "version").mapInArrow(
        _anchors(length, gram), "anchor long, version long, start int, count short, place short")
    dealt = found.repartition(partitions(spark), "anchor")
    # The minima of the other columns let both sides of the join read one exchange; the shared anchors of a
    # partition are few beside its rows, so they are hashed and the rows are not sorted.
    shared = dealt.groupBy("anchor").agg(
        F.min("version").alias("low"), F.max("version").alias("high"), F.count("*").alias("crowd"),
        F.min("start").alias("a"), F.min("count").alias("b"), F.min("place").alias("c")).where(
        "low <> high and a >= 0 and b >= 0 and c >= 0").select("anchor", "crowd")
    kept = stage(dealt.join(shared.hint("shuffle_hash"), "anchor").groupBy("anchor", "version", "start", "count", "place").agg(
        F.max("crowd").alias("crowd")), "anchors")
    del found, dealt, shared
    release(spark)
    own = kept.groupBy("version").agg(F.collect_list(F.struct("anchor", "start", "count", "place", "crowd")).alias("own"))
    first = texts.groupBy("version").agg(F.min("doc").alias("doc"))
    cut = texts.join(own.join(first, "version"), ["doc", "version"])
    snippet = lambda a: F.substring(F.col("data"), a["start"] + 1, a["count"] + (length - 1))
    pieces = stage(cut.select("doc", "version", F.explode(F.transform("own", lambda a: F.struct(
        a["anchor"].alias("anchor"), a["start"].alias("start"), a["place"].alias("place"),
        (a["crowd"] > crowd).alias("crowded"), snippet(a).alias("snippet")))).alias("p")).select(
        "doc", "version", "p.*"), "snippets")
    release(spark)
    few = pieces.where(~F.col("crowded")).repartition(partitions(spark), "anchor").sortWithinPartitions("anchor").select(
        "anchor", "doc", "version", F.col("start").cast("long").alias("start"), F.col("place").cast("long").alias("place"), "snippet")
    spans = few.mapInArrow(_merged(length, gram, GROUP, SHARD), "doc long, version long, `from` long, `to` long")
    # Rows of crowded anchors are gathered by snippet, some 2^14 rows of a task at a time, so common snippets are few rows in the joins.
    # All but those of a snippet's smallest id are copies of it; only that one's strings meet those of other snippets.
    many = stage(pieces.where("crowded").groupBy("snippet", F.shiftright(F.monotonically_increasing_id(), 14).alias("part")).agg(
        F.min("doc").alias("least"), F.collect_list(F.struct("doc", "version", F.col("start").cast("long").alias("start"))).alias("own")),
        "crowds")
    kinds = stage(many.groupBy("snippet").agg(F.min("least").alias("least")), "crowd-kinds")
    windows = kinds.select("snippet", F.col("least").alias("doc"), F.posexplode(F.transform(
        F.sequence(F.lit(1), F.octet_length("snippet") - (length - 1)), lambda i: F.substring(
            F.col("snippet"), i, F.lit(length)))).alias("at", "string"))
    first_in = windows.groupBy("string").agg(F.min("doc").alias("earliest"))
    # The places of a snippet whose strings stand in one of a smaller id.
    before = windows.join(first_in, "string").where("earliest < doc").groupBy("snippet").agg(F.collect_list("at").alias("places"))
    hot = many.drop("least").join(kinds.join(before, "snippet", "left"), "snippet").select(
        "own", "least", "places", F.octet_length("snippet").cast("long").alias("size")).mapInArrow(
        _spread(length), "doc long, version long, `from` long, `to` long")
    return spans.union(hot)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, size, removed, spans, digest = [], [], [], [], []
        for name, data, found, copy in zip(*(batch.column(c).to_pylist() for c in ("doc", "data", "spans", "copy"))):
            runs: list[list[int]] = [[0, len(data)]] if copy and data else []
            for span in sorted((s["from"], s["to"]) for s in found or []) if not copy else []:
                if runs and span[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span[1])
                else:
                    runs.append(list(span))
            kept, at = [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rest = b"".join(kept)
            doc.append(None if name == _FIRST else name)
            size.append(len(data))
            removed.append(len(data) - len(rest))
            spans.append([{"from": a, "to": b} for a, b in runs])
            digest.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
             pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256)`` of every row; ``spans`` are the removed byte runs."""
    spark = docs.sparkSession
    spans = stage(repeated_spans(docs, length, gram, crowd), "spans")
    release(spark)
    texts = _bytes(docs)
    # Later copies of a text; only ids and hashes of the texts are grouped.
    names = texts.select("doc", "version", F.octet_length("data").alias("size"))
    first = names.groupBy("version").agg(F.min("doc").alias("first"))
    copies = names.where(F.col("size") >= length).join(first, "version").where("first < doc").select(
        "doc", "version").distinct().withColumn("copy", F.lit(True))
    marks = spans.groupBy("doc", "version").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    both = texts.join(marks.join(copies, ["doc", "version"], "full"), ["doc", "version"], "left")
    return both.select("doc", "data", "spans", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, spans array<struct<`from`:long,`to`:long>>, kept_sha256 string")
