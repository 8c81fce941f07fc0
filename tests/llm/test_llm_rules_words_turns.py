"""Decision-list rules, spelling variants and conversation repair against plain versions of them."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from telemill.llm import conversations as CV, quality as QC, rules as RU, spelling as SP
from telemill.llm.shared import stage

# -- rules --------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def base_rows(docs):
    return [(r.doc_id, (*(r[c] for c in RU.BASE), r.base_failed)) for r in RU.statistics(docs).collect()]


def test_statistics_by_definition(spark, documents, texts, edge, none):
    assert dict(base_rows(documents)) == {n: brute_base(t) for n, t in texts.items()}
    assert sorted(base_rows(edge), key=repr) == sorted(((r.doc_id, brute_base(r.text)) for r in edge.collect()), key=repr)
    assert base_rows(none) == []


@pytest.mark.parametrize("words", [["a", "b"], ["a"], ["x", "a", "b", "c"]])
def test_statistics_of_repeats(spark, words):
    draw = random.Random(len(words))
    made = [" ".join(draw.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 4, 7, 60, 333)]
    made += ["\n".join(draw.choice(["", " ", "one", "one two"]) for _ in range(40)), "a\x0bb\x1cc d " * 30 + "# <|>"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert dict(base_rows(docs)) == {i: brute_base(t) for i, t in enumerate(made)}


def test_statistics_of_a_long_text(spark):
    text = " ".join(f"w{i % 49_999}" for i in range(150_000)) + "\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert base_rows(docs)[0][1] == brute_base(text)


def plain_rules(rows):
    """Sequential covering with the same thresholds and bars, over a list of (statistics, junk, grow)."""
    import math

    def takes(terms, s):
        return all((s[t.statistic] >= t.cut) == t.above for t in terms)

    points = {}
    for name in RU.STATISTICS:
        found = set()
        for junk in (False, True):
            own = sorted(s[name] for s, j, _ in rows if j == junk)
            if own:
                found |= {own[max(0, math.ceil((i + 0.5) / RU.CUTS * len(own)) - 1)] for i in range(RU.CUTS)}
        points[name] = sorted(found)
    rules, left = [], rows
    while len(rules) < RU.MAX_RULES:
        terms, own = (), [(s, j) for s, j, grow in left if grow]
        while len(terms) < RU.MAX_TERMS:
            p0 = sum(j for _, j in own)
            if not p0 or p0 == len(own):
                break
            best = None
            for name in RU.STATISTICS:
                for cut in points[name]:
                    for above in (True, False):
                        t = RU.Term(name, above, cut)
                        kept = [j for s, j in own if takes((t,), s)]
                        p = sum(kept)
                        if p:
                            gain = p * (math.log2(p / len(kept)) - math.log2(p0 / len(own)))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, t
            if best is None:
                break
            terms += (best[1],)
            own = [(s, j) for s, j in own if takes((best[1],), s)]
        if not terms:
            break
        options = []
        for k in range(1, len(terms) + 1):
            every = [(j, g) for s, j, g in left if takes(terms[:k], s)]
            held = [j for j, g in every if not g]
            p, n = sum(held), len(held) - sum(held)
            options.append(((p - n) / (p + n) if held else -1.0, -k, p, sum(j for j, _ in every), len(every)))
        _, k, p, junk, taken = max(options)
        if not p or junk < RU.PRECISION * taken:
            break
        rules.append(terms[:-k])
        left = [r for r in left if not takes(rules[-1], r[0])]
    return rules


def test_rules_equal_plain_covering(spark):
    draw = random.Random(5)
    names = list(RU.STATISTICS)
    rows = []
    for _ in range(400):
        s = {n: round(draw.random(), 2) for n in names}
        junk = (s[names[1]] > 0.7 and s[names[2]] < 0.5) or s[names[4]] > 0.9
        rows.append((s, junk != (draw.random() < 0.02), draw.random() < 0.67))
    struct = ", ".join(f"{n}: double" for n in names)
    given = spark.createDataFrame([(tuple(s[n] for n in names), j, g) for s, j, g in rows],
                                  f"_s struct<{struct}>, _junk boolean, _grow boolean")
    rules = RU.learn(given)
    assert rules == plain_rules(rows) and len(rules) >= 2
    first = [r[0] for r in given.select(RU.verdict(rules)).collect()]
    for (s, _, _), got in zip(rows, first):
        want = next((i for i, rule in enumerate(rules, 1) if all((s[t.statistic] >= t.cut) == t.above for t in rule)), 0)
        assert got == want
    assert "CASE WHEN" in given.select(RU.verdict(rules))._jdf.queryExecution().analyzed().toString()


def test_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = stage(RU.statistics(docs), "statistics")
    judged = RU.judge(stats, RU.fit(stats, labels.where(~QC.held_out())))
    rows = judged.where("NOT base_failed").join(labels.where(QC.held_out()), "doc_id").collect()
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.97 * sum(r.quality == 1 for r in rows)
    junk = [r for r in judged.join(labels, "doc_id").collect() if r.quality == 0]
    assert sum(not r.kept for r in junk) >= 0.8 * len(junk)


def test_rules_without_labels(spark, edge, none):
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 0), (9, None), (5, 0)], "doc_id long, quality int")
    for docs in (edge, none):
        stats = stage(RU.statistics(docs, ["doc_id", "words", "n_words"][:1]), "statistics")
        for given in (labels, labels.limit(0)):
            rows = RU.judge(stats, RU.fit(stats, given)).collect()
            assert len(rows) == docs.count()
            assert all(r.kept is not None and not (r.kept and r.base_failed) for r in rows)


# -- spelling variants --------------------------------------------------------


def brute_words(rows):
    seen = Counter()
    for n, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if n is None else n}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_variants(counts):
    by, near = defaultdict(list), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1:]].append(w)
            if w[:i] + w[i + 1:] in counts:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in by.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * n:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


def found_variants(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_of_documents(spark, documents, texts, edge, none):
    assert found_variants(SP.variants(documents)) == brute_variants(brute_words(texts.items()))
    assert found_variants(SP.variants(edge)) == brute_variants(brute_words([(r.doc_id, r.text) for r in edge.collect()]))
    assert SP.variants(none).count() == 0


def test_near_pairs_by_definition(spark):
    draw = random.Random(3)
    made = set()
    for _ in range(60):
        w = "".join(draw.choice("abé") for _ in range(draw.randrange(7, 16)))
        for _ in range(6):
            i, c = draw.randrange(len(w) + 1), draw.choice("abéÿ")
            w = draw.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])
            made.add(w) if len(w) >= 7 else None
    # A row of one letter meets its neighbours under every key.
    made |= {"a" * n for n in range(7, 15)}
    vocabulary = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(sorted(made))], "word string, n long")
    got = [frozenset((r.a, r.b)) for r in SP.near_pairs(vocabulary).collect()]
    want = {frozenset((a, b)) for a in made for b in made if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_chain_of_forms(spark):
    # Ten times as frequent at every step; the last word has a tie for its form.
    chain = ["abcdefgh", "abcdefgi", "abcdefii", "abcdeiii"]
    vocabulary = [(w, 2 * 10 ** i) for i, w in enumerate(chain)] + [("xxxxxxx", 5), ("xxxxxxa", 50), ("xxxxxxb", 50), ("yyyyyyyy", 9)]
    df = stage(spark.createDataFrame(vocabulary, "word string, n long"), "v")
    got = found_variants(SP.roots(stage(SP.forms(df), "f")))
    assert got == brute_variants(dict(vocabulary))
    assert {r[5] for r in got if r[0] in chain} == {chain[-1]} and ("xxxxxxx", 5, 2, "xxxxxxa", 50, "xxxxxxa") in got


def test_native_plans(spark, documents):
    for df in (SP.words(documents), RU.statistics(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# -- conversations ------------------------------------------------------------

_STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_NAME = {"u": "user", "a": "assistant"}


def brute_repair(rows):
    """Cheapest edits of (role, text, gone, truncated) rows by uniform cost, the least string first."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        done.add((i, state))
        for x in _NAME:
            if x in _STEP[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, _STEP[state][x], out + (_NAME[x] + ":",)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if not gone:
                if role[:1] in _STEP[state]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, _STEP[state][role[:1]], out + (f"{role}:{text}",)))
                for x in _NAME:
                    if x in _STEP[state]:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, _STEP[state][x], out + (f"{_NAME[x]}:{text}",)))


def brute_conversation(given):
    rows = []
    for conv, turn, role, text in given:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            rows += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts, coded = set(), Counter(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        kind = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[kind] += 1
        coded.append((role, text, kind in ("blank", "duplicate"), int(kind == "truncated")))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = brute_repair(coded)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check_repair(df):
    got = {r.conv_id: tuple(r)[1:] for r in CV.repair(CV.damage(df)).collect()}
    by = defaultdict(list)
    for r in df.collect():
        by[r.conv_id].append((r.conv_id, r.turn, r.role, r.text))
    assert got == {c: brute_conversation(rows) for c, rows in by.items()}
    return got


def test_repair_of_conversations(spark):
    got = check_repair(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    assert any("I" in r[6] for r in got.values()) and any("D" in r[6] for r in got.values())


def test_repair_edges(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string, part long, block long, audit string, _c long"
    draw = random.Random(9)
    rows = []
    for i in range(2500):
        rows.append((draw.choice([7, 7, 7, None, 3, 4, i, i % 50]), draw.choice([None, i // 2, i]),
                     draw.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "S"]),
                     draw.choice(["Yes.", "No", f"x{i}.", "", "  ", None, "Well! \n", " ", "é?\t" * 50]), 0, 1, "K", i))
    check_repair(spark.createDataFrame(rows, schema).repartition(5))
    assert CV.repair(CV.damage(spark.createDataFrame([], schema))).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = CV.repair(CV.damage(spark.createDataFrame([(dropped, 0, "user", "x")], "conv_id long, turn long, role string, text string"))).first()
    assert tuple(only) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_search_and_blocks(spark):
    draw = random.Random(1)
    for _ in range(600):
        rows = [(draw.choice(["system", "user", "assistant", "user", "tool"]), "x", draw.random() < .2, int(draw.random() < .2))
                for _ in range(draw.randrange(0, 9))]
        code = bytes((4 if role == "tool" else "sua".find(role[0])) | (16 if gone else 8 * cut) for role, _, gone, cut in rows)
        want = brute_repair(rows)
        assert CV.Search(code).best(0) == want[:2]
        cut = sorted(draw.randrange(0, len(rows) + 1) for _ in range(2))
        chain, pieces = CV._Chain(), []
        for a, b in zip([0] + cut, cut + [len(rows)]):
            block = CV._Block(1)
            block.codes, block.roles, block.texts = bytearray(code[a:b]), [""] * (b - a), [""] * (b - a)
            pieces.append(block.piece(0, len(pieces)))
            chain.add(pieces[-1]["costs"], pieces[-1]["ranks"], (0, len(pieces) - 1))
        ways = list(chain.states())[::-1]
        assert "".join(p["audits"][4 * w[1] + w[2]] + w[3] for p, w in zip(pieces, ways)) == want[1]


def test_one_conversation_is_spread(spark):
    """A conversation of most rows is dealt to several tasks and still reads as one."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"Line {i}." if i % 11 else "same") for i in range(3000)] + [(2, 0, "user", "Hm.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = CV.ordered(CV.damage(df)).where("_c = 1").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 2000
    check_repair(df)
