"""One query for each operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill.llm import (
    conversations as CV, decontaminate as DC, edit_embedding as EE, lines as LN, packing as PK, quality as QC, repeats as RP, rules as RU,
    simhash as SH, spelling as SP, token_file as TF, toxicity as TX, warc as WA)
from telemill.llm.shared import folder, prepare, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_simhash_near_dedup(spark, sf_dir):
    prepare(spark)
    return SH.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", SH.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op2_rans_token_file(spark, sf_dir):
    prepare(spark)
    path = folder(spark, "token-file")
    TF.write(table(spark, sf_dir, "documents"), path)
    return TF.read_checksums(spark, path)


@query
def op4_shortest_pack_first(spark, sf_dir):
    prepare(spark)
    return PK.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op5_suffix_array_decontamination(spark, sf_dir):
    prepare(spark)
    return DC.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", DC.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), DC.contaminated().alias("contaminated"))


# Windows of items, occurrences by equality of the joined words, words covered by any of them.
ORACLE["op5_suffix_array_decontamination"] = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, grams.n, i FROM grams JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT docs.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op8_pu_quality(spark, sf_dir):
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = QC.fit(docs, labels.where(~QC.held_out()))
    return QC.score(docs, model).select(
        "doc_id", QC.held_out().alias("held_out"), "score", (F.col("score") >= QC.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_toxic_segments(spark, sf_dir):
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = TX.fit(docs, labels.where(~TX.held_out()))
    return TX.score(docs, model).select(
        "doc_id", TX.held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TX.THRESHOLD).cast("int").alias("predicted"))


@query
def op3_warc(spark, sf_dir):
    prepare(spark)
    path = folder(spark, "warc")
    WA.write_pages(table(spark, sf_dir, "pages"), path)
    # Sizes and digests are those of the payloads read back; a revisit tells its response's.
    records = WA.read(spark, path, payload=False, verify=True).where(F.col("record_type").isin("response", "revisit"))
    return records.select(
        WA.page_id_of("record_id").alias("page_id"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        WA.page_id_of("refers_to").alias("refers_to"))


def _base32_sql(sha: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    value = [f"CAST(('0x' || substr({sha}, {5 * i + 1}, 5)) AS BIGINT)" for i in range(8)]
    return " || ".join(f"substr({letters}, CAST((({v}) >> {s}) & 31 AS BIGINT) + 1, 1)" for v in value for s in (15, 10, 5, 0))


ORACLE["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_base32_sql('sha')} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (sha)
"""


@query
def op1_edit_embedding(spark, sf_dir):
    prepare(spark)
    return EE.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op7_fuzzy_lines(spark, sf_dir):
    prepare(spark)
    return LN.keep_first(table(spark, sf_dir, "documents"), None).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_removed"), "text")


@query
def op6_repeated_strings(spark, sf_dir):
    prepare(spark)
    return RP.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op11_decision_list(spark, sf_dir):
    prepare(spark)
    stats = stage(RU.statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = RU.fit(stats, table(spark, sf_dir, "labels").where(~QC.held_out()))
    return RU.judge(stats, rules).select("doc_id", *RU.BASE, "base_failed", "kept")


@query
def op12_spelling_variants(spark, sf_dir):
    prepare(spark)
    return SP.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


# CRC-32 byte by byte from its table; words one edit apart are equal where one character is a gap, or where one of them lacks it.
ORACLE["op12_spelling_variants"] = r"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) AS t(i)),
crc AS (SELECT list(v ORDER BY i) AS v FROM bits),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
         unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS r FROM documents),
low AS (SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (
  SELECT r, c, xor(4294967295, list_reduce(
           [4294967295::BIGINT] || list_transform(range(octet_length(encode(d || ':' || r))),
             lambda k: CAST('0x' || substr(hex(encode(d || ':' || r)), 2 * k + 1, 2) AS BIGINT)),
           lambda a, b: xor(a >> 8, crc.v[(xor(a, b) & 255) + 1]))) AS h
  FROM low, crc),
slipped AS (
  SELECT c, CASE WHEN h % 31 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word
  FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
gaps AS (SELECT word, n, left(word, i - 1) || chr(1) || substr(word, i + 1) AS g, left(word, i - 1) || substr(word, i + 1) AS w FROM places),
less AS (SELECT DISTINCT gaps.word, gaps.n, v.word AS other, v.n AS m FROM gaps JOIN v ON gaps.w = v.word),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.g = b.g AND a.word <> b.word
  UNION ALL SELECT word, other, m FROM less UNION ALL SELECT other, word, n FROM less),
best AS (SELECT word, count(*) AS k, max(m) AS m FROM near GROUP BY word),
named AS (
  SELECT v.word, v.n, coalesce(k, 0) AS n_near, CASE WHEN best.m >= 10 * v.n THEN best.m END AS form_n
  FROM v LEFT JOIN best USING (word)),
formed AS (
  SELECT named.word, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n, min(other) AS form
  FROM named LEFT JOIN near ON named.word = near.word AND named.form_n = near.m GROUP BY named.word),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, f.form FROM chain JOIN formed f ON chain.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN formed f ON chain.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query
def op13_conversation_repair(spark, sf_dir):
    return CV.repair(CV.damage(table(spark, sf_dir, "conversations")))
