"""Inputs that once broke operators: ties at batch places, documents of many lines, clashing column names, repeated ids."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from telemill.llm import lines as LN, quality as QC, repeats as RP, simhash as SH, toxicity as TX, warc as WA
from telemill.llm.tokens import Encoder, vocabulary_path

SF = "/root/testdata/sf0.001"


def tied_string():
    """Fifty bytes whose least hashed gram stands at offsets 3 and 20."""
    draw = np.random.default_rng(4)
    while True:
        gram, rest = draw.integers(97, 123, 17, np.uint8), draw.integers(97, 123, 16, np.uint8)
        text = np.concatenate([rest[:3], gram, gram, rest[3:]])[:50]
        hashes = RP._gram_hashes(text, 16) >> np.uint64(20)
        if hashes[3] == hashes[20] == hashes.min():
            return text.tobytes()


def test_repeats_across_batch_places(spark):
    string, edge = tied_string(), 1 << 20
    draw = np.random.default_rng(5)
    for before in (edge - 10, edge - 30, edge - 45, edge - 500):
        first = draw.integers(97, 123, 200, np.uint8).tobytes() + string + b"."
        filler = draw.integers(97, 123, before - len(first), np.uint8).tobytes()
        texts = [first, filler + string + draw.integers(97, 123, 200, np.uint8).tobytes()]
        own, anchor, start, count, place = RP.anchor_runs(texts, 50, 16)
        at = [(200, 0), (len(filler), 1)]
        found = [next((a, p + s - o) for t, a, s, c, p in zip(own, anchor, start, count, place) if t == i and s <= o < s + c)
                 for o, i in at]
        assert found[0] == found[1]
        docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        rows = {r.doc_id: r.n_removed for r in RP.remove_repeats(docs).collect()}
        assert rows == {0: 0, 1: 50}


@pytest.mark.parametrize("distance", [None, 3])
def test_a_document_of_many_lines(spark, distance):
    draw = np.random.default_rng(6)
    body = [" ".join(f"w{w}" for w in draw.integers(0, 1 << 30, 7)) for _ in range(20_000)]
    same = "the very same line stands here twice and goes once"
    docs = spark.createDataFrame([(1, "\n".join([same, *body, same, "", same])), (2, "short")], "doc_id long, text string")
    rows = {r.doc_id: r for r in LN.keep_first(docs, distance).collect()}
    assert rows[1].text == "\n".join([same, *body, ""]) and (rows[1]._lines, rows[1]._dropped) == (20_004, 2)


def test_generated_lines_leave_the_text_behind(spark, documents):
    for df in (LN.plain_occurrences(documents), LN.occurrences(documents)):
        plan = df._jdf.queryExecution().optimizedPlan()
        while not plan.getClass().getSimpleName().startswith("Generate") or "posexplode" not in plan.generator().toString():
            plan = plan.children().head()
        kept = plan.output().mkString(",")
        assert "version" in kept and "t#" not in kept.replace("text", "")


CLASH = ["id", "label", "toxic", "head_id", "_lines", "_dropped", "_head", "_doc", "_text", "drop", "version"]


def test_clashing_columns_in_every_stage(spark, documents):
    docs = documents.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    plain = documents
    for name, step in corpus_pipeline.STAGES[:3]:
        out, want = step(spark, docs, SF), step(spark, plain, SF)
        assert out.columns == docs.columns
        # Counts that the caller cannot see are put under free names, so its own columns stay.
        assert [out.agg(F.min(c), F.max(c)).first()[:] for c in CLASH] == [(i, i) for i in range(len(CLASH))]
        assert sorted(map(str, out.select(*documents.columns).collect())) == sorted(map(str, want.collect())), name
        docs, plain = spark.createDataFrame(out.collect(), out.schema), \
            spark.createDataFrame(want.collect(), want.schema)


def test_fit_reads_a_repeated_id_once(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = documents.unionByName(documents).unionByName(documents.limit(20))
    assert TX.fit(documents, labels).scores.keys() == TX.fit(twice, labels).scores.keys()
    a, b = QC.fit(documents, labels), QC.fit(documents.unionByName(documents), labels)
    assert np.allclose(a.weights, b.weights, atol=1e-4)


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "quite another text of some words"),
            (2, "one two three four five six"), (3, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "") for r in SH.keep_one(docs).collect())
    assert got == [("1", "one two three four five six"), ("1", "quite another text of some words"), ("3", ""), ("None", "x")]


def test_byte_alphabet_of_the_encoder():
    encoder = Encoder(vocabulary_path())
    texts = ["naïve Straße ÿþ ·«»­¬ ¡¿ ñandú œuvre żółć été, 日本語 ключ", "é" * 50, "a b ­x", "".join(map(chr, range(0xA1, 0x180)))]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert list(ids) == encoder.library.encode(text, add_special_tokens=False).ids


def test_verified_digests_are_those_of_the_bytes(spark, tmp_path):
    good, bad = b"<html>good</html>", b"<html>altered</html>"
    http = lambda body: b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(good) + body
    stated = "sha1:" + base64.b32encode(hashlib.sha1(good).digest()).decode()
    records = [WA.member(WA.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{i}>"), ("WARC-Payload-Digest", stated),
                                    ("Content-Type", "application/http;msgtype=response")], http(body)))
               for i, body in enumerate((good, bad))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    for verify in (False, True):
        rows = {r.record_id: r for r in WA.read(spark, f"file://{tmp_path}", False, verify).collect()}
        assert rows["<r0>"].payload_digest == stated and rows["<r0>"].payload_bytes == len(good)
        assert (rows["<r1>"].payload_digest == stated) != verify
        assert rows["<r1>"].payload_bytes == (len(bad) if verify else len(good)) and rows["<r1>"].payload is None
