"""SimHash, fuzzy lines, repeated strings, decontamination: each against brute force."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
from xxhash import xxh64_intdigest

from telemill.llm import decontaminate as DC, lines as LN, repeats as RP, simhash as SH
from telemill.llm.components import components
from telemill.llm.queries import ORACLE

from conftest import SF


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def bits(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    return bits([xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams])


def brute_components(fps, distance=3):
    groups, names = Groups(), sorted(fps)
    values = np.array([fps[n] for n in names], np.uint64)
    for i, name in enumerate(names):
        groups.find(name)
        for j in np.nonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance)[0]:
            groups.join(name, names[i + 1 + j])
    return {n: groups.find(n) for n in names}


def test_simhash_groups(documents, texts, edge, none):
    got = {r.doc_id: (int(r.h, 16), r.component_id) for r in SH.near_duplicates(documents).select(
        "doc_id", SH.as_hex("fp").alias("h"), "component_id").collect()}
    fps = {n: brute_simhash(t) for n, t in texts.items()}
    want = brute_components(fps)
    assert got == {n: (fps[n], want[n]) for n in texts}
    rows = SH.near_duplicates(edge).select("doc_id", SH.as_hex("fp").alias("h"), "component_id").collect()
    assert len(rows) == edge.count()
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 1), (2, 1), (3, 1)}
    assert {r.component_id for r in rows if r.doc_id == 7} == {5}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert SH.near_duplicates(none).count() == 0
    kept = SH.keep_one(edge)
    assert kept.columns == edge.columns
    # The repeated row of 5 goes, its other text stays.
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 5, 8, 9]
    assert SH.keep_one(none).count() == 0


def test_anchors_meet_every_close_pair():
    draw = np.random.default_rng(5)
    a = draw.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(b)):
        for k in draw.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(int(k))
    reach = SH.RADIUS + 1
    ra, ka, na = SH.anchors_of(a, reach)
    rb, kb, _ = SH.anchors_of(b, reach)
    homes, copies = [set() for _ in a], [set() for _ in a]
    for r, k, n in zip(ra, ka, na):
        if n:
            homes[r].add(k)
    for r, k in zip(rb, kb):
        copies[r].add(k)
    assert all(h & c for h, c in zip(homes, copies))


def test_dense_clusters_in_blocks(spark):
    draw = random.Random(3)
    base, fps = draw.getrandbits(64), {}
    for i in range(400):
        value = base
        for k in draw.sample(range(64), i % 6):
            value ^= 1 << k
        fps[i] = value
    fps |= {1000 + i: draw.getrandbits(64) for i in range(200)}
    members = {}
    for n, v in fps.items():
        members.setdefault(v, n)
    table = spark.createDataFrame([(n, v - (1 << 64) if v >> 63 else v) for v, n in members.items()], "node long, fp long")
    want = brute_components({n: v for v, n in members.items()})
    for block in (4096, 16):
        links = SH.close_links(table, block=block)
        assert links.count() < 20 * len(members)
        got = {r.node: r.component for r in components(links).collect()}
        assert {n: got.get(n, n) for n in want} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3), (201, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 260))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- lines --------------------------------------------------------------------


def norm(line):
    return re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", line.lower()).strip(" ")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows):
    """``rows`` in order of (doc_id, text); the text each keeps."""
    nodes, seen_at = {}, []
    for d, t in rows:
        for i, line in enumerate(t.split("\n")):
            if key := norm(line):
                nodes.setdefault(key, len(nodes))
                seen_at.append(((d, t), i, key))
    keys = list(nodes)
    fps = np.array([bits([xxh64_intdigest(w.encode(), 42) for w in k.split(" ")]) for k in keys], np.uint64)
    groups = Groups()
    for i in range(len(keys)):
        for j in np.nonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 3)[0] + i + 1:
            a, b = keys[i].split(" "), keys[j].split(" ")
            if edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                groups.join(i, j)
    first, drop = {}, {}
    for doc, i, key in seen_at:
        group = groups.find(nodes[key])
        if first.setdefault(group, (doc, i)) != (doc, i):
            drop.setdefault(doc, set()).add(i)
    return {doc: "\n".join(x for i, x in enumerate(doc[1].split("\n")) if i not in drop.get(doc, ())) for doc in rows}


def variants(n):
    """A crowd of variants of one line, in chains and stars."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(60)]
    out = []
    for i in range(n):
        own = list(base)
        for k in draw.sample(range(60), i % 3):
            own[k] = f"z{draw.randrange(10 ** 6)}"
        out.append((i + 1, " ".join(own) + f"\nLine {i} alone"))
    return out


def test_lines_against_brute_force(spark, documents, texts):
    for docs, rows in ((documents, sorted(texts.items())),
                       (spark.createDataFrame(v := variants(80), "doc_id long, text string"), v)):
        got = {r.doc_id: r.text for r in LN.keep_first(docs).collect()}
        assert {n: got[n] or "" for n, _ in rows} == {n: t for (n, _), t in brute_lines(rows).items()}


def test_lines_edges(edge, none, spark):
    kept = LN.keep_first(edge)
    assert kept.columns == [*edge.columns, "_lines", "_dropped"]
    rows = kept.collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.text, r._lines, r._dropped))
    assert by[1] == [(None, 1, 0)] and by[2] == [("", 1, 0)] and by[7] == [("", 1, 1)]
    assert sorted(x[2] for x in by[5]) == [0, 0, 0]
    assert LN.keep_first(none).count() == 0
    long = " ".join(f"a{i}" for i in range(17_000))
    two = spark.createDataFrame([(1, long), (2, long + "!\nend")], "doc_id long, text string")
    assert [r.text for r in LN.keep_first(two).orderBy("doc_id").collect()] == [long, "end"]


def brute_similar(rows):
    """As ``brute_lines``, by edit similarity alone."""
    keys = list(dict.fromkeys(k for _, t in rows for line in t.split("\n") if (k := norm(line))))
    words, groups = [k.split(" ") for k in keys], Groups()
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            n = max(len(a), len(words[j]))
            if abs(len(a) - len(words[j])) <= n // 5 and edit_distance(a, words[j]) <= n // 5:
                groups.join(i, j)
    at, seen, out = {k: i for i, k in enumerate(keys)}, set(), {}
    for d, t in rows:
        kept = []
        for line in t.split("\n"):
            group = groups.find(at[k]) if (k := norm(line)) else None
            if group is None or group not in seen:
                kept.append(line)
            seen.add(group)
        out[d] = "\n".join(kept)
    return out


def test_lines_by_similarity_alone(spark):
    draw = random.Random(4)
    rows = variants(16)
    for n in (4, 5, 9, 10, 30):
        for _ in range(2):
            base = [f"v{draw.randrange(60)}" for _ in range(n)]
            for _ in range(5):
                own = list(base)
                for _ in range(draw.randrange(n // 5 + 3)):
                    k = draw.randrange(len(own))
                    own[k:k + draw.randrange(2)] = [f"v{draw.randrange(60)}"] * draw.randrange(2)
                    own = own or ["v"]
                rows.append((len(rows) + 1, " ".join(own) + "\nthe the the the " + "of " * draw.randrange(4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_similar(rows)
    assert {r.doc_id: r.text for r in LN.keep_first(docs, None).collect()} == want
    assert any(want[d] != t for (d, _), t in brute_lines(rows).items())
    # A repeated row has fuzzy partners like any other.
    twice = spark.createDataFrame([(1, "a b c d e f")] * 2 + [(2, "a b c d e g\nend")], "doc_id long, text string")
    assert sorted(r.text for r in LN.keep_first(twice, None).collect()) == ["a b c d e f"] * 2 + ["end"]


def test_similar_lines_are_staged_once(spark, monkeypatch):
    """No staged table repeats the facts of a line for each of its keys, and hubs do not change the groups."""
    draw = random.Random(6)
    base = [[f"w{draw.randrange(400)}" for _ in range(30)] for _ in range(40)]
    rows = [(i, " ".join(f"v{draw.randrange(400)}" if draw.random() < 0.08 else w for w in base[i % 40])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    staged, real = {}, LN.stage
    monkeypatch.setattr(LN, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    assert {r.doc_id: r.text for r in LN.keep_first(docs, None).collect()} == brute_similar(rows)
    assert not staged["lines"].inputFiles() or not os.path.exists(staged.pop("lines").inputFiles()[0].replace("file://", ""))
    assert all(df.count() <= 200 for name, df in staged.items() if "n" in df.columns or "key" in df.columns)
    monkeypatch.setattr(LN, "stage", real)
    names = LN.line_nodes(LN.stage(LN.plain_occurrences(docs), "lines"))
    wanted = {(r.id, r.component) for r in LN.similar_groups(docs, names).collect()}
    assert wanted and wanted == {(r.id, r.component) for r in LN.similar_groups(docs, names, crowd=2).collect()}


def test_line_simhash_equals_brute_force(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(f"x{draw.randrange(50)}" for _ in range(n))) for i, n in enumerate((1, 2, 3, 40, 127, 128, 300, 16383, 16384))]
    got = {r.doc_id: r.fp % (1 << 64) for r in LN.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: bits([xxh64_intdigest(w.encode(), 42) for w in t.split(" ")]) for i, t in rows}


# -- repeated strings ---------------------------------------------------------


def brute_repeats(rows, length=50):
    first = {}
    for name, data in sorted(rows):
        for i in range(len(data) - length + 1):
            first.setdefault(data[i:i + length], name)
    out = []
    for name, data in rows:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < name:
                gone[i:i + length] = True
        edge = np.diff(np.r_[0, gone.astype(int)])
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((name, len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def found_repeats(docs, **options):
    rows = RP.remove_repeats(docs, **options).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in rows)


def test_repeats_against_brute_force(documents, texts, edge, none):
    rows = [(n, t.encode()) for n, t in texts.items()]
    assert found_repeats(documents) == brute_repeats(rows)
    assert found_repeats(documents, crowd=2) == brute_repeats(rows)
    plain = [(-1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in edge.collect()]
    assert found_repeats(edge) == brute_repeats(plain)
    assert found_repeats(none) == []


def test_crowded_snippets_are_gathered(spark, monkeypatch):
    """A passage that all texts share is a few rows in the joins, whatever the number of texts."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    common = " ".join(word() for _ in range(30))
    other = common[:120] + "#" + common[121:]
    rows = [(i, f"{' '.join(word() for _ in range(4))} {[common, other][i % 3 == 2]} {' '.join(word() for _ in range(4))}")
            for i in range(300)]
    staged, real = {}, RP.stage
    monkeypatch.setattr(RP, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert found_repeats(docs, crowd=50) == brute_repeats([(n, t.encode()) for n, t in rows])
    crowded = staged["snippets"].where("crowded")
    assert crowded.count() > 2000 and staged["crowds"].count() < crowded.count() / 4


def test_merge_of_transforms():
    draw = random.Random(4)
    for alphabet in (b"ab", b"abcdefgh", bytes(range(256))):
        strings = list({bytes(draw.choice(alphabet) for _ in range(draw.randrange(50, 84))) for _ in range(30)})
        base = strings[0]
        strings += [base[:30] + bytes(draw.choice(alphabet) for _ in range(30)), base + b"a", b"a" + base]
        counts = np.array([max(0, len(s) - 19) for s in strings])
        owners = np.array([draw.randrange(9) for _ in strings])
        least = {}
        for s, c, o in zip(strings, counts, owners):
            for i in range(c):
                least[s[i:i + 20]] = min(least.get(s[i:i + 20], 99), o)
        for shard in (64, 10 ** 6):
            got = RP.earlier(strings, counts, owners, 20, shard)
            assert [list(g) for g in got] == [[least[s[i:i + 20]] for i in range(c)] for s, c in zip(strings, counts)]


# -- decontamination ----------------------------------------------------------


def test_decontamination_equals_sql(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.sql(ORACLE["op5_suffix_array_decontamination"]).fetchall()}
    for options in ({}, {"block_words": 200, "shard_words": 3000}):
        got = {r.doc_id: (r.n_words, r.n, len(r["items"]), DC.items_digest(r["items"]), r.c) for r in DC.overlaps(
            documents, bench, **options).withColumn("n", DC.n_hit()).withColumn("c", DC.contaminated()).collect()}
        assert got == want


def test_decontamination_edges(spark, edge, none):
    bench = spark.createDataFrame(
        [(1, "derselben Nummer"), (2, None), (3, " -- "), (1, "Wort"), (None, "sätze, der"), (4, "ein satz der zweimal vorkommt und lang genug")],
        "item_id long, text string")
    rows = DC.overlaps(edge, bench, carry=["doc_id", "text"]).collect()
    assert len(rows) == edge.count()
    items = {r.doc_id: r["items"] for r in rows if r.doc_id != 5}
    assert items[4] == ["1"] and items[7] == ["4"] and items[1] == [] and items[8] == []
    kept = DC.keep_clean(edge, bench)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 8, 9]
    assert DC.keep_clean(edge, bench.limit(0)).count() == edge.count()
    assert DC.keep_clean(none, bench).count() == 0


def test_longest_matches(spark, documents, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(6)
    split = {n: [w.decode() for w in DC.words_of(t)] for n, t in texts.items()}
    joined = {n: " " + " ".join(w) + " " for n, w in split.items()}
    got = {(r.item_id, r.place): r for r in DC.longest_matches(documents, bench, shard_words=5000).collect()}
    for row in bench.collect():
        own = [w.decode() for w in DC.words_of(row.text)]
        for place in range(0, len(own), 7):
            best = 0
            while place + best < len(own) and any(
                    f" {' '.join(own[place:place + best + 1])} " in t for t in joined.values()):
                best += 1
            found = got.get((str(row.item_id), place))
            assert (found.length if found else 0) == best
            if found:
                there = split[found.doc_id][found.doc_place:found.doc_place + best]
                assert there == own[place:place + best]
