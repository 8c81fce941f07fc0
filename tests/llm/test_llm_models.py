"""WARC archives, the two scorers and the pipeline."""

import base64
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from telemill.llm import decontaminate as DC, quality as QC, simhash as SH, toxicity as TX, warc as WA
from telemill.llm.logistic import calibrate

from conftest import SF
from test_llm_duplicates import brute_lines

NOISE = "".join(chr(0x100 + i * i * 7919 % 20011) for i in range(9000))
PAGES = [(3, "http://a/3", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, "u\nv", NOISE), (4, None, None),
         (5, "", ""), (None, "x", "<p>same</p>"), (None, "y", "alone"), (6, "d", "twice"), (6, "d", "twice")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, folder):
    WA.write_pages(pages(spark), f"{folder}/w")
    rows = WA.read(spark, f"{folder}/w").where("record_type <> 'warcinfo'").select(
        WA.page_id_of("record_id").alias("id"), "record_type", WA.page_id_of("refers_to").alias("to"), "payload_digest",
        "payload_bytes", "payload", "target_uri").collect()
    assert len(rows) == len(PAGES)
    got = sorted((r.id or 0, r.record_type, r.to or 0, r.payload_digest, r.payload_bytes) for r in rows)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        to = first.get(html or "", i)
        want.append((i or 0, "response" if to == i else "revisit", 0 if to == i else to,
                     "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data)))
    assert got == sorted(want)
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    assert all(r.payload is None for r in rows if r.record_type == "revisit")
    assert WA.read(spark, f"{folder}/none").count() == 0
    WA.write_pages(pages(spark, PAGES[:0]), f"{folder}/empty")
    assert WA.read(spark, f"{folder}/empty").count() == 0
    # Payloads from 10 bytes on are matched only: "twice" is shorter.
    WA.write_pages(pages(spark, [(1, "", "twice"), (2, "", "twice")]), f"{folder}/least", least=10)
    assert WA.read(spark, f"{folder}/least").where("record_type = 'response'").count() == 2


def test_warc_filters_are_answered_from_headers(spark, folder, tmp_path):
    WA.write_pages(pages(spark), f"{folder}/w")
    reader = WA.WarcReader({"path": f"{folder}/w", "splitBytes": "1"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringStartsWith

    left = list(reader.pushFilters([In(("record_type",), ("response",)), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert list(reader.pushFilters([IsNotNull(("target_uri",)), StringStartsWith(("target_uri",), "http"),
                                    EqualTo(("record_id",), "<urn:page:1>")])) == []
    parts = reader.partitions()
    assert len(parts) == len(list((p for x in parts for p in x.paths)))
    assert [r[1] for p in parts for r in reader.read(p)] == ["<urn:page:1>"]
    scan = WA.read(spark, f"{folder}/w").where("record_type = 'revisit'")
    assert scan.count() == 3
    # A damaged payload is not met where the payload is not wanted.
    big = max((x for x in Path(f"{folder}/w").iterdir() if x.suffix == ".gz"), key=lambda x: x.stat().st_size)
    data = bytearray(big.read_bytes())
    with open(big, "rb") as source:
        at = {h.get("warc-record-id"): o for o, h, _ in WA.Members(source)}["<urn:page:2>"]
    middle = at + int.from_bytes(data[at + 16:at + 20], "little") - 60
    data[middle:middle + 20] = bytes(20)
    (tmp_path / "x.warc.gz").write_bytes(data)
    only = WA.WarcReader({"path": str(tmp_path)})
    list(only.pushFilters([In(("record_type",), ("warcinfo", "revisit"))]))
    list(only.read(only.partitions()[0]))
    with pytest.raises(Exception):
        every = WA.WarcReader({"path": str(tmp_path)})
        list(every.read(every.partitions()[0]))


def test_warc_members_without_sizes(tmp_path):
    import gzip

    records = [WA.record([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<r{i}>"), ("Content-Type", "text/plain")],
                         b"x" * i * 5000) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    reader = WA.WarcReader({"path": str(tmp_path)})
    assert [(r[1], r[7]) for r in reader.read(reader.partitions()[0])] == [(f"<r{i}>", i * 5000) for i in range(4)]


# -- scorers ------------------------------------------------------------------


def brute_segments(at, scores, drift):
    """Maximal segments by definition: recursively the best segment, then both sides of it."""
    n = int(max(at)) + 1 if len(at) else 0
    values = np.full(n, -drift)
    values[at] = scores
    out = []

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                    best = (i, j + 1, total)
        if best:
            split(a, best[0])
            out.append(best)
            split(best[1], b)

    split(0, n)
    return out


def test_segments_by_definition():
    draw = random.Random(2)
    for _ in range(60):
        at = np.array(sorted(draw.sample(range(30), draw.randrange(0, 8))), np.int64)
        scores = np.array([draw.random() * 3 + 0.01 for _ in at])
        got, want = TX.segments(at, scores, 0.5), brute_segments(at, scores, 0.5)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def accuracy(rows, label):
    ok = [(r.score >= r.bar) == (r[label] == 1) for r in rows]
    return sum(ok) / len(ok)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = TX.score(docs, TX.fit(docs, labels.where(~TX.held_out()))).join(labels.where(TX.held_out()), "doc_id").select(
        F.col("toxicity").alias("score"), F.lit(TX.THRESHOLD).alias("bar"), "toxic").collect()
    assert accuracy(toxic, "toxic") > 0.93
    good = QC.score(docs, QC.fit(docs, labels.where(~QC.held_out()))).join(labels.where(QC.held_out()), "doc_id").select(
        "score", F.lit(QC.THRESHOLD).alias("bar"), "quality").collect()
    assert accuracy(good, "quality") > 0.95


def test_scorers_edges(spark, edge, none):
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (None, 1, 1), (99, 0, 1), (4, None, None)],
                                   "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = TX.fit(edge, given)
        rows = TX.score(edge, model).collect()
        assert len(rows) == edge.count() and all(0 <= r.toxicity <= 1 for r in rows)
        assert TX.score(none, model).count() == 0
        assert TX.keep_clean(edge, model).columns == edge.columns
        model = QC.fit(edge, given)
        rows = QC.score(edge, model).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
        assert QC.score(none, model).count() == 0
    assert TX.fit(none, labels).scores == {}


def test_non_negative_risk_separates():
    draw = np.random.default_rng(0)

    def rows(n, good):
        return [(np.array([0 if draw.random() < (0.9 if good else 0.1) else 1, 2]), np.ones(2)) for _ in range(n)]

    positive = QC.Rows(rows(400, True))
    mixed = QC.Rows(rows(300, True) + rows(100, False))
    weights, bias = QC.train(positive, mixed, 0.75, epochs=20)
    assert weights[0] > weights[1]
    slope, shift = calibrate(np.array([-2.0, -1, 1, 2] * 10), np.array([0, 0, 1, 1] * 10))
    assert slope > 0 and abs(shift) < 1


def test_unlabelled_risk_is_over_all_documents(spark, monkeypatch):
    texts = [f"Line {i}, {'x' * (i % 7)} {i * i}!" for i in range(9_000)]
    docs = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200) if i % 3], "doc_id long, quality int")
    seen, sums = [], QC.unlabelled_sums
    monkeypatch.setattr(QC, "unlabelled_sums", lambda *a: seen.append((a[1], *(got := sums(*a)))) or got)
    QC.fit(docs, labels)
    w, gradient, risk, n = seen[-1]
    assert len(seen) == QC.STEPS and n == len(texts)
    made = [QC.features(t) for t in texts]
    z = np.array([w[i] @ v for i, v in made]) + w[-1]
    want = np.zeros(QC.SIZE + 1)
    for (i, v), p in zip(made, 1 / (1 + np.exp(-z))):
        want[i] += p * v
        want[-1] += p
    assert np.allclose(gradient, want / n, atol=1e-5) and abs(risk - np.logaddexp(0, z).mean()) < 1e-5


# -- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark, documents):
    """Every stage against a plain version of it, over what the one before kept."""
    docs, kept = documents, {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        if name == "packing":
            break
        assert out.columns == documents.columns
        kept[name] = {r.doc_id: r.text or "" for r in out.collect()}
        docs = spark.createDataFrame(out.collect(), documents.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = TX.score(documents, TX.fit(documents, labels.where(~TX.held_out())))
    assert set(kept["toxicity"]) == {r.doc_id for r in scored.where(F.col("toxicity") < TX.THRESHOLD).collect()}
    rows = sorted(kept["toxicity"].items())
    assert kept["line_dedup"] == {n: t for (n, _), t in brute_lines(rows).items()}
    from test_llm_duplicates import brute_components, brute_simhash

    groups = brute_components({n: brute_simhash(t) for n, t in kept["line_dedup"].items()})
    assert set(kept["near_dedup"]) == set(groups.values())
    before = spark.createDataFrame(list(kept["near_dedup"].items()), "doc_id long, text string")
    bad = DC.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where(DC.contaminated())
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {r.doc_id for r in bad.collect()}
    packed = out.collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
    assert all(r.offset + r.length <= 4096 for r in packed)
    assert SH.DISTANCE == 3


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns
