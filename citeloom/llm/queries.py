"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, cross_polytope, crf_pii, cube_mix, fm_quality, hist_pack, jaccard_join, kd_shards, line_dedup, minhash_hamming, syncmers, warc_index, wavelet_search
from .shared import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hist_pack.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.shard_documents(table(spark, sf_dir, "documents"), 8, columns=("doc_id",))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crf_pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [F.regexp_count("base_spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in crf_pii.KINDS]
    return out.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", F.regexp_count("spans", F.lit(":[0-9]+:")).cast("long").alias("n_spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_index.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


def op9_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = fm_quality.train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return fm_quality.score(docs, machine).select("doc_id", fm_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube_mix.mix_sources(table(spark, sf_dir, "documents"), columns=("doc_id",))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_hamming.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM d),
l AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
j AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key AND length(k.key) >= 20)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(b, doc_id)) AS BIGINT) AS component_id FROM s LEFT JOIN least ON least.a = doc_id
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM b
"""


OP11_SQL = r"""
WITH RECURSIVE keyed AS (SELECT *, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS kind FROM keyed),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM rows),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM placed),
turns AS (SELECT conv_id, turn, pos, role, text, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
counted AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
put(a, b, r) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
filled(a, b, cost, audit, lines) AS (SELECT s, s, 0, '', CAST([] AS VARCHAR[]) FROM range(4) t(s)
  UNION ALL SELECT a, b, 2, 'I', [CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM put WHERE r <> 's'
  UNION ALL SELECT p.a, q.b, 4, 'II', [CASE p.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END, CASE q.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM put p JOIN put q ON p.b = q.a AND p.r <> 's' AND q.r <> 's'),
edits AS (SELECT conv_id, pos, s AS a, s AS b, 3 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS lines FROM turns, range(4) t(s)
  UNION ALL SELECT conv_id, pos, a, b, CASE fault WHEN 3 THEN 1 ELSE 0 END, 'K', [role || ':' || text] FROM turns JOIN put ON initial = r WHERE fault NOT IN (1, 2)
  UNION ALL SELECT conv_id, pos, a, b, CASE fault WHEN 3 THEN 3 ELSE 2 END, 'R', [CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM turns JOIN put ON r <> 's' WHERE fault NOT IN (1, 2)),
walk(conv_id, pos, best) AS (SELECT conv_id, CAST(0 AS BIGINT), {'state': CAST(0 AS BIGINT), 'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} FROM counted
  UNION ALL SELECT w.conv_id, w.pos + 1, arg_min({'state': CAST(e.b AS BIGINT), 'cost': w.best.cost + f.cost + e.cost, 'audit': w.best.audit || f.audit || e.audit, 'lines': w.best.lines || f.lines || e.lines},
      {'cost': w.best.cost + f.cost + e.cost, 'audit': w.best.audit || f.audit || e.audit})
    FROM walk w JOIN filled f ON f.a = w.best.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos + 1 AND e.a = f.b GROUP BY w.conv_id, w.pos, e.b),
done AS (SELECT w.conv_id, arg_min({'cost': w.best.cost + f.cost, 'audit': w.best.audit || f.audit, 'lines': w.best.lines || f.lines}, {'cost': w.best.cost + f.cost, 'audit': w.best.audit || f.audit}) AS best
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos JOIN filled f ON f.a = w.best.state AND f.b IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
posting AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY r, doc_id, n, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM posting, size GROUP BY term, n_docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, term),
scored AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN posting USING (term), size GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

OP13_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(b, doc_id)) AS BIGINT) AS component_id, b IS NULL OR doc_id <= b AS kept FROM s LEFT JOIN least ON least.a = doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_cross_polytope, op3_packing, op4_kd_sharding, op5_pii_crf, op6_jaccard_join, op7_warc_index, op8_syncmer_fingerprints, op9_fm_quality, op10_cube_mix, op11_conversation_repair, op12_wavelet_search, op13_minhash_hamming)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op6_jaccard_join": OP6_SQL, "op7_warc_index": OP7_SQL, "op11_conversation_repair": OP11_SQL, "op12_wavelet_search": OP12_SQL, "op13_minhash_hamming": OP13_SQL}
