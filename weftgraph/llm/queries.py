"""The registered queries of the ten components, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, exact_dedup, line_dedup, media, minhash, mixing, pii, quality, toxicity, warc
from weftgraph.llm.common import is_held_out, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_ld_n_lines").alias("n_lines"), F.col("_ld_n_dropped").alias("n_dropped"), F.sha2("_ld_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~is_held_out(F.col("doc_id"), 3, 1))
    rows = docs.select("doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), toxicity.score(docs, net, F.col("text")).alias("score"), toxicity.threshold(net, F.col("lang")).alias("lang_threshold"))
    return rows.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=4)


def op4_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    coder = bpe.codec(path or public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.token_digests(spark, F.col("text"), coder).alias("t")).select("doc_id", "t.*")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"), ~is_held_out(F.col("doc_id"), 5, 0))
    rows = docs.select("doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), quality.score(docs, net, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base_spans")), 256).alias("base_sha256"), pii.span_text(F.col("all_spans")).alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_minhash, op4_byte_bpe, op5_media, op6_quality, op7_exact_dedup, op8_pii, op9_mixing, op10_warc)}

_FOLD = f"'{line_dedup.UPPER}', '{line_dedup.LOWER}'"

ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_FOLD}) AS key FROM u),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id <> s.keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL OR k.doc_id = s.keeper), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY k.doc_id""",
    "op3_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id""",
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op9_mixing": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size / weight AS full_at, sum(source_size) OVER () * 1.5 AS total FROM g),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight FROM f
  WINDOW o AS (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(total - filled AS DOUBLE) / open_weight AS level FROM c),
t AS (SELECT source, source_size, CAST(least(weight * coalesce((SELECT arg_min(level, full_at) FROM v WHERE level <= full_at), full_at), 2 * source_size) AS DOUBLE) AS target FROM v),
q AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS passes FROM t),
b AS (SELECT *, CAST(floor(target - passes * source_size) AS BIGINT) AS rest FROM q),
n AS (SELECT d.*, b.source_size, b.target, b.passes, b.rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM n""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((instr('0123456789abcdef', substr(s, CAST(1 + (5 * i) // 4 AS INTEGER), 1)) - 1) * 16
    + instr('0123456789abcdef', substr(s, CAST(2 + (5 * i) // 4 AS INTEGER), 1)) - 1) // CAST(pow(2, 3 - (5 * i) % 4) AS INTEGER)) % 32 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM x""",
}
