"""Fingerprints, token files and packing."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from telemill.llm import edit_embedding as EE, packing as PK, rans, token_file as TF
from telemill.llm.tokens import Encoder, vocabulary_path

ODD = ["", " ", "İstanbul ΑΣ Σ", "it's WE'LL x'd '", " a  b\x1cc d é ́x", "<|endoftext|> hi", "日本語 テスト 123 4a5",
       "ªº µ ß ẞ ÿŸ", "... , a.b ,,", "a_b __ --x-- (hi)!", " x　y", "don't 'tis 're", "é Å ﬁ"]


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    return [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def test_encoder_equals_the_library(texts):
    given = [*ODD, *texts.values()]
    for room in (5, 10_000):
        own = Encoder(vocabulary_path(), room)
        assert [list(map(int, x)) for x in own.encode(given)] == library_ids(given)


@pytest.mark.parametrize("n", [0, 1, 31, 33, 4096, 16384, 16385, 70_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 40_000).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=1))
    frames = rans.encode(ids, table)
    assert np.array_equal(rans.decode(frames, table), ids)
    assert np.array_equal(rans.decode(frames[1:], table), ids[rans.BLOCK:])  # a block stands alone
    if n > 31:
        broken = bytearray(frames[0])
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.decode([bytes(broken)], table)
        with pytest.raises(ValueError):
            rans.decode([frames[0][:-4]], table)
        with pytest.raises(ValueError):
            rans.decode(frames, rans.Table.of_counts(np.bincount(ids, minlength=1) + 1))


def checksums(rows, end_id):
    out, start = [], 0
    for (name, _), own in zip(rows, library_ids([t for _, t in rows])):
        ids = np.array([*own, end_id], "<u4").tobytes()
        out.append((name, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_token_file(spark, documents, edge, none, folder):
    for i, docs in enumerate((documents, edge, none)):
        TF.write(docs, f"{folder}/{i}", segment=5000)
        got = TF.read_checksums(spark, f"{folder}/{i}").orderBy("start").collect()
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [tuple(r) for r in got] == checksums(rows, TF.END_ID)
        whole = {(r.doc_id, r.start): bytes(r.ids) for r in TF.read(spark, f"{folder}/{i}").collect()}
        assert all(zlib.crc32(whole[r.doc_id, r.start]) == r.ids_crc32 for r in got)


def test_packing(documents, edge, none):
    for docs, length in ((documents, 4096), (documents, 100), (edge, 64), (none, 4096)):
        got = PK.pack(docs, length).collect()
        wanted = Counter()
        for row, own in zip(rows := docs.collect(), library_ids([r.text or "" for r in rows])):
            wanted[row.doc_id, np.array([*own, PK.END_ID], "<u4").tobytes()] += 1
        fill, ids = {}, {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill.get(r.sequence_id, 0) and r.length > 0
            fill[r.sequence_id] = r.offset + r.length
            assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert all(n <= length for n in fill.values())
        assert sorted(fill) == list(range(len(fill)))
        for r in got:
            ids.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
        assert sum(r.length for r in got) == sum(len(k[1]) // 4 * n for k, n in wanted.items())
        for (name, ids_), n in wanted.items():  # every id in exactly one piece
            pieces = ids[name, len(ids_) // 4]
            for a in range(0, len(ids_), 4 * length):
                assert pieces.count((a // 4, ids_[a:a + 4 * length])) >= n
        if len(fill) > 20:
            assert sum(fill.values()) >= 0.97 * length * len(fill)


def test_packing_without_ids(documents):
    a = sorted(map(tuple, PK.pack(documents, 512, with_ids=False).select("doc_id", "start", "length").collect()))
    b = sorted(map(tuple, PK.pack(documents, 512).select("doc_id", "start", "length").collect()))
    assert a == b


def test_fingerprints_follow_edits(texts):
    walk = EE.walker()
    base = [t for t in texts.values() if len(t) > 1500][:20]
    near = walk.fingerprints([t[:700] + "x" + t[701:] for t in base])
    far = walk.fingerprints(base[1:] + base[:1])
    own = walk.fingerprints(base)
    assert np.mean([EE.likeness(a, b) for a, b in zip(own, near)]) > 0.9
    assert np.mean([EE.likeness(a, b) for a, b in zip(own, far)]) < 0.1
    # In a batch, alone or finished by the plain loop: the same walk.
    many = walk.fingerprints(base * 40)
    assert many[:20] == own == [walk.fingerprints([t])[0] for t in base]
    assert EE.likeness(b"", b"") == 1 and EE.likeness(b"", own[0]) == 0


def edits(rows):
    out = []
    for (name, text), (_, follower) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        changed = text[:len(text) - n] + follower[:n]
        out.append((name, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    return out


def test_fingerprint_edits(documents, edge, none, texts):
    got = EE.fingerprint_edits(documents).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == edits(sorted(texts.items()))
    assert np.mean([r.near_edited for r in got]) > 0.65 and np.mean([r.near_next for r in got]) < 0.1
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    got = EE.fingerprint_edits(edge).collect()
    known = [r for r in edge.collect() if r.doc_id is not None]
    rows = sorted(((r.doc_id, r.text or "") for r in known))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == sorted(edits(rows))
    alone = [r for r in got if r.doc_id is None]
    assert len(alone) == 1 and alone[0].near_next is None
    assert EE.fingerprint_edits(none).count() == 0
    assert EE.fingerprint_edits(edge.where("doc_id = 4")).first().near_next == 1.0  # its own follower
