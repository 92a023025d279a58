"""Queries over chunks: turns of a conversation stand for a document's chunks, their first long words for keyphrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import annotate as A
from weftgraph.functions import text as T
from weftgraph.operators import enrich as E
from weftgraph.operators import markdown as M
from weftgraph.operators import similarity as X
from weftgraph.plans.core import MD_SQL, _digest, _md, _t, query
from weftgraph.sources import exports, graphs

WORD = r"[\p{L}]{5,}"
C_SQL = f"c AS (SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE 'doc' || conv_id END AS doc, conv_id, turn, role, text, regexp_extract_all(lower(text), '{WORD}')[1:6] AS kps FROM conversations)"
NEXT_SQL = "e AS (SELECT a.id AS a, b.id AS b, a.doc AS doc_a, b.doc AS doc_b, a.kps AS kps_a, b.kps AS kps_b, a.text AS text_a, b.text AS text_b FROM c a JOIN c b ON b.id = a.id + 1)"
WS = "[^\\s\\p{Z}]+"


def _c(s, d):
    kps = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), 1, 6)
    doc = F.when(F.col("conv_id") % 7 == 0, None).otherwise(F.concat(F.lit("doc"), "conv_id"))
    return _t(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), doc.alias("doc"), "conv_id", "turn", "role", "text", kps.alias("kps"))


def _next(s, d):
    """Edges between turns that follow each other."""
    c = _c(s, d).select("id")
    return c.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(c.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


# ---- cleaning and extraction ----


@query("affiliations", "SELECT doc_id, md5('# T ' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'plain ' || source ELSE 'keep' END || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## Abstract' || chr(10) || 'me@x.org' ELSE 'tail' || chr(10) || '## 1 Start' END || chr(10) || 'x@y.zz') AS digest FROM documents")
def _(s, d):
    md = F.expr("'# T ' || doc_id || chr(10) || 'Doe 1 University of ' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'plain ' || source ELSE 'keep' END || chr(10) || 'A. Doe†' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## Abstract' || chr(10) || 'me@x.org' ELSE 'tail' || chr(10) || 'b@c.de' || chr(10) || '## 1 Start' END || chr(10) || 'x@y.zz'")
    return _t(s, d, "documents").select("doc_id", _digest(T.remove_affiliations(md)).alias("digest"))


@query("normalize_markdown", "WITH d AS (SELECT doc_id, replace(replace(coalesce(text, '') || chr(13) || chr(10) || '  x  ' || chr(13) || chr(10) || chr(10) || chr(10) || 'y ', chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents), e AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)[^\\S\\n]+$', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS t FROM d) SELECT doc_id, md5(CASE WHEN regexp_matches(t, '(?m)^\\s*#') THEN t ELSE '# a b' || chr(10) || chr(10) || t END) AS digest FROM e")
def _(s, d):
    text = F.expr("coalesce(text, '') || chr(13) || chr(10) || '  x  ' || chr(13) || chr(10) || chr(10) || chr(10) || 'y '")
    return _t(s, d, "documents").select("doc_id", _digest(T.normalize_markdown(text, F.lit("a_b"))).alias("digest"))


@query("decorative_images", "SELECT o_orderkey, length(repeat('A', CAST(o_orderkey % 4000 + 1 AS INTEGER))) * 3 // 4 < 2048 AS decorative FROM orders")
def _(s, d):
    uri = F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("A"), (F.col("o_orderkey") % 4000 + 1).cast("int")))
    return _t(s, d, "orders").select("o_orderkey", T.is_decorative(uri).alias("decorative"))


@query("replace_images", "SELECT item_id, 'a ' || chr(10) || '> 📷 **Chart ' || item_id || '** : said ' || item_id || ' b  c > 📷 **Figure 3** : two' AS text FROM benchmark")
def _(s, d):
    b64 = F.repeat(F.lit("QUJD"), 1000)
    md = F.concat(F.lit("a \n![Chart "), "item_id", F.lit("](data:image/png;base64,"), b64, F.lit(") b ![logo](data:image/png;base64,AAAA)<!-- image --> c ![image](data:image/png;base64,"), b64, F.lit(")"))
    said = F.array(F.concat(F.lit("said "), "item_id"), F.lit(None).cast("string"), F.lit("two"))
    return _t(s, d, "benchmark").select("item_id", T.replace_images(md, said).alias("text"))


@query("clean_reply", "SELECT item_id, 'One ' || item_id || '. Two! Three?' AS text FROM benchmark")
def _(s, d):
    reply = F.concat(F.lit("## Image Description:\n# Head\nOne "), "item_id", F.lit(". Two! Three? Four."))
    return _t(s, d, "benchmark").select("item_id", T.clean_reply(reply).alias("text"))


@query("feature_counts", f"WITH {MD_SQL} SELECT doc_id, len(regexp_extract_all(md, '(?s)```([A-Za-z0-9_]+)?\\n(.*?)```')) > 0 AS has_code, CAST(len(regexp_extract_all(md, '(?s)```([A-Za-z0-9_]+)?\\n(.*?)```')) AS INTEGER) AS code_block_count, CAST(len(regexp_extract_all(md, '`([^`]+)`')) AS INTEGER) AS inline_code_count, CAST(1 AS INTEGER) AS table_count FROM md")
def _(s, d):
    return _md(s, d).select("doc_id", *[v.alias(k) for k, v in M.feature_counts(F.col("md")).items()])


@query("appears_verbatim", f"WITH {C_SQL}, n AS (SELECT id, trim(regexp_replace(lower(text), '[\\s\\p{{Z}}]+', ' ', 'g'), ' ') AS t, lower(regexp_extract(text, '\\S+\\s+\\S+')) AS two FROM c) SELECT id, contains(t, trim(regexp_replace(two, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')) OR contains(trim(regexp_replace(replace(t, '-', ' '), '[\\s\\p{{Z}}]+', ' ', 'g'), ' '), trim(regexp_replace(replace(two, '-', ' '), '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')) AS found FROM n")
def _(s, d):
    return _c(s, d).select("id", T.appears_verbatim(F.regexp_extract("text", r"\S+\s+\S+", 0), F.col("text")).alias("found"))


@query("contains_edges", "SELECT conv_id AS a, conv_id * 100 + turn AS b, 'contains' AS type, CAST(turn AS BIGINT) AS \"order\" FROM conversations")
def _(s, d):
    return E.contains_edges(_c(s, d).withColumn("i", F.col("turn").cast("bigint")), "conv_id", "id", "i")


@query("markdown_names", "SELECT page_id, regexp_replace(split_part(p, '/', -1), '\\.[^.]*$', '') || '_' || substr(md5(p), 1, 6) || '.md' AS name FROM (SELECT page_id, '/in/f_' || page_id || '.v2.pdf' AS p FROM pages)")
def _(s, d):
    from weftgraph.sources.files import markdown_name

    return _t(s, d, "pages").select("page_id", markdown_name(F.concat(F.lit("/in/f_"), F.col("page_id").cast("string"), F.lit(".v2.pdf"))).alias("name"))


# ---- keyphrases ----


@query("eligible_chunks", f"WITH {C_SQL} SELECT id FROM c WHERE len(kps) > 3")
def _(s, d):
    return _c(s, d).filter(E.eligible(F.col("kps"))).select("id")


@query("blacklist_filter", f"WITH {C_SQL}, x AS (SELECT id, list_concat(kps, ['Notes', '3.14', 'ab', 'vs.', 'x-1', 'Figure ']) AS k FROM c), u AS (SELECT id, unnest(k) AS p FROM x) SELECT id, count(*) AS n FROM u WHERE lower(trim(p)) NOT IN ('notes', 'figure') AND NOT regexp_matches(trim(p), '(?i)^(\\d+\\.?\\d*|[a-z0-9]{{1,2}}|vs\\.?|x-\\d)$') GROUP BY id")
def _(s, d):
    k = F.concat("kps", E.literals(["Notes", "3.14", "ab", "vs.", "x-1", "Figure "]))
    return _c(s, d).select("id", F.size(E.without_blacklisted(k, patterns=(r"x-\d",))).cast("bigint").alias("n")).filter("n > 0")


@query("phrase_dedupe", f"WITH {C_SQL} SELECT id, CAST(len(list_distinct(kps)) AS INTEGER) AS n FROM c")
def _(s, d):
    return _c(s, d).select("id", F.size(F.array_distinct("kps")).alias("n"))


@query("document_ids", f"WITH {C_SQL} SELECT id, coalesce(CASE WHEN turn = 0 THEN 'm' || id END, nullif(CASE WHEN turn = 1 THEN '' ELSE role END, ''), doc, substr(CAST(id AS VARCHAR), 1, 8)) AS doc FROM c")
def _(s, d):
    meta, name = F.when(F.col("turn") == 0, F.concat(F.lit("m"), "id")), F.when(F.col("turn") == 1, "").otherwise(F.col("role"))
    return _c(s, d).select("id", E.document_of(meta, name, F.col("doc"), F.col("id")).alias("doc"))


@query("inverted_index", f"WITH {C_SQL}, u AS (SELECT DISTINCT id, unnest(kps) AS p FROM c) SELECT p, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM u GROUP BY p")
def _(s, d):
    parts = E.inverted_index(_c(s, d).select("id", F.explode("kps").alias("p")), "p", "id")
    return parts.groupBy("p").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.flatten(F.collect_list("nodes"))), ",").alias("ids"))


@query("rule_keyphrases")
def _(s, d):
    return A.with_keyphrases(_c(s, d).withColumn("cached", F.when(F.col("turn") == 0, F.array(F.lit("kept")))), "id", "text", "cached").select("id", F.array_join("keyphrases", "/").alias("keyphrases"))


@query("fuzzy_pairs")
def _(s, d):
    return _t(s, d, "part").select("p_partkey", X.fuzzy_pairs(F.array("p_name", "p_type"), F.array("p_type", F.concat(F.lit("big "), "p_name"))).alias("m")).select("p_partkey", F.to_json("m").alias("pairs"))


@query("shared_keyphrases", f"WITH {C_SQL}, {NEXT_SQL} SELECT a, b, array_to_string(list_sort(list_distinct(list_intersect(kps_a, kps_b))), '/') AS shared_keyphrases, CAST(len(list_distinct(list_intersect(kps_a, kps_b))) AS BIGINT) AS shared_count FROM e")
def _(s, d):
    return E.shared_keyphrases(_next(s, d), _c(s, d), "id", "kps").withColumn("shared_keyphrases", F.array_join("shared_keyphrases", "/"))


# ---- similarity ----


@query("kp_overlap", f"WITH {C_SQL}, u AS (SELECT DISTINCT id, unnest(kps) AS x FROM c), n AS (SELECT id, count(*) AS n FROM u GROUP BY id), m AS (SELECT a.id AS a, b.id AS b, count(*) AS n_matches FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2) SELECT a, b, n_matches, round(n_matches / (x.n * y.n), 6) AS score FROM m JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE n_matches / (x.n * y.n) >= 0.05")
def _(s, d):
    return X.keyphrase_overlap_join(_c(s, d), "id", "kps", score=0.05, exact=True, items=False).select("a", "b", "n_matches", F.round("score", 6).alias("score"))


@query("kp_overlap_fuzzy", "WITH u AS (SELECT DISTINCT p_size AS id, lower(p_name) AS x FROM part WHERE p_partkey % 5 = 0), n AS (SELECT id, count(*) AS n FROM u GROUP BY id), m AS (SELECT a.id AS a, b.id AS b, count(*) AS n_matches FROM u a JOIN u b ON jaro_winkler_similarity(a.x, b.x) >= 0.9 AND a.id < b.id GROUP BY 1, 2) SELECT a, b, n_matches, round(n_matches / (x.n * y.n), 6) AS score FROM m JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE n_matches / (x.n * y.n) >= 0.1")
def _(s, d):
    chunks = _t(s, d, "part").filter("p_partkey % 5 = 0").groupBy(F.col("p_size").alias("id")).agg(F.collect_list("p_name").alias("kps"))
    return X.keyphrase_overlap_join(chunks, "id", "kps", score=0.1).select("a", "b", "n_matches", F.round("score", 6).alias("score"))


@query("intra_doc_drop", f"WITH {C_SQL}, {NEXT_SQL} SELECT a, b FROM e WHERE doc_a IS NULL OR doc_b IS NULL OR doc_a <> doc_b")
def _(s, d):
    one = lambda x: _c(s, d).select(F.col("id").alias(x), F.col("doc").alias(f"doc_{x}"))
    return _next(s, d).join(one("a"), "a").join(one("b"), "b").filter(E.of_different_documents(F.col("doc_a"), F.col("doc_b"))).select("a", "b")


BAND = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM v a JOIN v b ON a.id < b.id)"


@query("embedding_cosine_band", f"{BAND} SELECT a, b, round(cosine, 4) AS cosine_score FROM p WHERE cosine BETWEEN 0.3 AND 0.9")
def _(s, d):
    return X.cosine_band(_t(s, d, "embeddings"), "vec_id", "embedding", 0.3, 0.9).select("a", "b", F.round("cosine", 4).alias("cosine_score"))


@query("tfidf_grams", f"WITH {C_SQL}, w AS (SELECT id, doc, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM c), t AS (SELECT id AS d, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM w), f AS (SELECT d, t, count(*) AS tf FROM t GROUP BY d, t), g AS (SELECT t, count(*) AS df FROM f GROUP BY t), n AS (SELECT count(DISTINCT d) AS n FROM f), x AS (SELECT d, t, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM f JOIN g USING (t), n), y AS (SELECT d, t, v / sqrt(sum(v * v) OVER (PARTITION BY d)) AS v FROM x), p AS (SELECT a.d AS a, b.d AS b, sum(a.v * b.v) AS cosine FROM y a JOIN y b ON a.t = b.t AND a.d < b.d GROUP BY 1, 2) SELECT a, b, round(cosine, 4) AS cosine_score FROM p JOIN c x ON x.id = a JOIN c z ON z.id = b WHERE cosine BETWEEN 0.15 AND 0.9 AND (x.doc IS NULL OR z.doc IS NULL OR x.doc <> z.doc)")
def _(s, d):
    c = _c(s, d)
    terms = c.select("id", F.explode(X.word_grams(F.col("text"))).alias("t"))
    near = X.cosine_terms(X.tfidf(terms, "id", "t"), "id", "t", 0.15, 0.9)
    one = lambda x: c.select(F.col("id").alias(x), F.col("doc").alias(f"doc_{x}"))
    return near.join(one("a"), "a").join(one("b"), "b").filter(E.of_different_documents(F.col("doc_a"), F.col("doc_b"))).select("a", "b", F.round("cosine", 4).alias("cosine_score"))


JACC = f"len(list_distinct(list_intersect(regexp_extract_all(lower(text_a), '{WS}'), regexp_extract_all(lower(text_b), '{WS}')))) / greatest(1, len(list_distinct(list_concat(regexp_extract_all(lower(text_a), '{WS}'), regexp_extract_all(lower(text_b), '{WS}')))))"


@query("anti_dup", f"WITH {C_SQL}, {NEXT_SQL} SELECT a, b, round({JACC}, 4) AS jaccard FROM e WHERE {JACC} < 0.05")
def _(s, d):
    return X.anti_duplicate(_next(s, d), _c(s, d), "id", "text", 0.05).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


@query("module_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A'")
def _(s, d):
    kind = F.when(F.col("l_returnflag") == "A", "cosine_similarity").otherwise("contains")
    return E.without_modules(_t(s, d, "lineitem").withColumn("type", kind), ["cosine_similarity", "contains"]).select("l_orderkey", "l_linenumber")


# ---- enrichment ----


@query("new_edges", "WITH k AS (SELECT l_partkey AS a, l_suppkey AS b, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2), m AS (SELECT least(a, b) AS x, greatest(a, b) AS y, min(seq) AS seq FROM k GROUP BY 1, 2) SELECT x, y, seq FROM m WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = x AND p.p_size = y)")
def _(s, d):
    cand = _t(s, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit("llm_triplet").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    have = _t(s, d, "part").filter("p_partkey <= p_size").select(F.col("p_size").cast("bigint").alias("a"), F.col("p_partkey").alias("b"), F.lit("llm_triplet").alias("type"))
    return E.new_edges(cand, have, "seq").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "seq")


@query("chunks_by_document", "SELECT conv_id, count(*) AS n, string_agg(role, '/' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def _(s, d):
    return E.chunks_by_document(_c(s, d), "conv_id", "turn", "role").select("conv_id", F.size("chunks").cast("bigint").alias("n"), F.array_join(F.transform("chunks", lambda x: x["role"]), "/").alias("roles"))


@query("best_content", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND role <> '' THEN role WHEN turn % 3 = 1 THEN substr(text, 1, 40) ELSE substr('page ' || conv_id, 1, 40) END AS content FROM conversations")
def _(s, d):
    k = F.col("turn") % 3
    summary, raw = F.when(k == 0, F.col("role")).otherwise(F.lit("")), F.when(k == 1, F.col("text")).otherwise(F.lit(""))
    return _t(s, d, "conversations").select("conv_id", "turn", E.best_content(summary, raw, F.concat(F.lit("page "), "conv_id"), 40).alias("content"))


@query("doc_preview", f"WITH w AS (SELECT conv_id, turn, role, regexp_extract_all(substr(text, 1, 600), '{WS}')[1:120] AS w FROM conversations) SELECT conv_id, md5(string_agg('[' || role || ']' || chr(10) || array_to_string(w, ' '), chr(10) || chr(10) ORDER BY turn)) AS digest FROM w GROUP BY conv_id")
def _(s, d):
    c = _c(s, d).withColumn("content", E.best_content(F.lit(""), F.col("text"), F.lit(""), 600))
    return E.doc_preview(c, "conv_id", "turn", "role", "content").select("conv_id", _digest(F.col("preview")).alias("digest"))


@query("validator_requests", f"WITH {C_SQL}, {NEXT_SQL} SELECT a, b, md5(substr(text_a, 1, 50)) AS content_a, md5(substr(text_b, 1, 50)) AS content_b FROM e")
def _(s, d):
    r = E.validator_requests(_next(s, d), _c(s, d), "id", "text", "role", 50)
    return r.select("a", "b", _digest(F.col("content_a")).alias("content_a"), _digest(F.col("content_b")).alias("content_b"))


@query("bridge_filter", "WITH b AS (SELECT l_orderkey AS bridge, l_partkey AS doc FROM lineitem WHERE l_partkey % 3 = 0) SELECT bridge, count(*) AS n FROM b GROUP BY bridge HAVING count(*) >= 2")
def _(s, d):
    bridges = _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("bridge")).agg(F.collect_list("l_partkey").alias("ids"))
    docs = _t(s, d, "part").filter("p_partkey % 3 = 0")
    return E.valid_bridges(bridges, "bridge", "ids", docs, "p_partkey").groupBy("bridge").agg(F.count("*").alias("n"))


@query("located_chunks", "SELECT l_orderkey, l_linenumber, unnest(list_filter([l_quantity::INT - 10, l_quantity::INT, 3, 7], lambda i: i >= 0 AND i < 20)[1:2]) AS chunk_index FROM lineitem")
def _(s, d):
    q = F.col("l_quantity").cast("int")
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(q - 10, q, F.lit(3), F.lit(7)).alias("i"), F.lit(20).alias("n"))
    return E.located_chunks(rows, "l_orderkey", "l_linenumber", "i", "n")


@query("bridge_chunk_pairs", "SELECT DISTINCT a.l_orderkey AS bridge, a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_suppkey <> b.l_suppkey")
def _(s, d):
    return E.bridge_pairs(_t(s, d, "lineitem").withColumnRenamed("l_orderkey", "bridge"), "bridge", "l_partkey", "l_linenumber", "l_suppkey")


@query("accepted_pairs", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic + 0.65 >= 0.65")
def _(s, d):
    rows = _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels"), "doc_id", "left")
    return E.accepted(rows, F.col("quality") == 1, F.col("toxic") + 0.65, 0.65).select("doc_id")


@query("slot_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(replace(p_name || ', the value ' || p_type, ',', ' ')), '\\S+'), lambda t: t NOT IN ('the', 'value')))), ' ') AS tokens FROM part")
def _(s, d):
    return _t(s, d, "part").select("p_partkey", F.array_join(F.array_sort(E.slot_tokens(F.concat("p_name", F.lit(", the value "), "p_type"))), " ").alias("tokens"))


FRAMES = "f AS (SELECT p_partkey AS node, p_size AS doc, string_split(lower(p_name), ' ') AS subject, [lower(p_type)] AS operation, [lower(p_brand)] AS object FROM part WHERE p_partkey < 400)"


@query("frame_overlap", f"WITH {FRAMES}, j AS (SELECT a.node AS a, b.node AS b, a.subject AS sa, b.subject AS sb, a.operation AS oa, b.operation AS ob, (len(list_intersect(a.subject, b.subject)) / len(list_distinct(list_concat(a.subject, b.subject))) >= 0.3)::INT + (a.operation = b.operation)::INT + (a.object = b.object)::INT AS n FROM f a JOIN f b ON a.node < b.node AND a.doc <> b.doc) SELECT a, b, CASE WHEN len(list_intersect(sa, sb)) > 0 THEN array_to_string(list_sort(list_intersect(sa, sb)), ' ') ELSE oa[1] END AS concept FROM j WHERE n >= 2 AND (len(list_intersect(sa, sb)) > 0 OR oa = ob)")
def _(s, d):
    rows = _t(s, d, "part").filter("p_partkey < 400").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("doc"), F.lit(0).alias("i"), F.col("p_name").alias("subject"), F.col("p_type").alias("operation"), F.col("p_brand").alias("object"), F.lit("N/A").alias("result"))
    return E.frame_overlap_join(rows, "node", "doc", "i")


@query("frame_vectors", f"{BAND} SELECT a, b FROM p WHERE b = a + 1 AND cosine >= 0.25")
def _(s, d):
    v = _t(s, d, "embeddings")
    pairs = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")).join(v.select(F.col("vec_id").alias("b")), "b", "left_semi").select("a", "b")
    return E.frame_embedding_filter(pairs, v, "vec_id", "embedding")


@query("concepts", f"WITH {C_SQL}, u AS (SELECT DISTINCT id, unnest(kps) AS concept FROM c) SELECT id, count(*) AS n FROM u GROUP BY id")
def _(s, d):
    up = F.transform("kps", lambda x: F.concat(F.lit(" "), F.upper(x), F.lit("  ")))
    return _c(s, d).select("id", F.size(E.distinct_concepts(F.concat("kps", F.when(F.col("id") < 0, up).otherwise(F.array().cast("array<string>"))))).cast("bigint").alias("n")).filter("n > 0")


@query("bridge_chunk_cap", "SELECT l_partkey, l_orderkey FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) <= 12")
def _(s, d):
    return E.bridge_chunks(_t(s, d, "lineitem"), "l_partkey", "l_orderkey")


@query("concept_relations", f"WITH {C_SQL}, r AS (SELECT l_orderkey % 300 * 100 AS a, l_partkey % 300 * 100 AS b, l_discount * 10 AS confidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), k AS (SELECT r.* FROM r JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE confidence >= 0.6 AND a <> b AND (x.doc IS NULL OR y.doc IS NULL OR x.doc <> y.doc)) SELECT a, b, seq FROM k QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq) = 1")
def _(s, d):
    r = _t(s, d, "lineitem").select((F.col("l_orderkey") % 300 * 100).alias("a"), (F.col("l_partkey") % 300 * 100).alias("b"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return E.concept_relations(r, _c(s, d), "id", "doc", "seq", cross_doc=True).select("a", "b", "seq")


@query("shared_keyphrase_edges", f"WITH {C_SQL}, u AS (SELECT DISTINCT id, unnest(kps) AS x FROM c) SELECT a.id AS a, b.id AS b, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    from weftgraph.operators.graph import shared_pairs

    return shared_pairs(_c(s, d).select("id", F.explode("kps").alias("x")), "id", "x", 2)


@query("entity_edges")
def _(s, d):
    return E.entity_edges(_c(s, d).select("id", "conv_id", F.explode("kps").alias("e")), "id", "conv_id", "e")


@query("pagerank")
def _(s, d):
    return E.pagerank(_t(s, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("p"), "o_orderpriority").alias("b")), "a", "b", rounds=5).select("node", F.round("rank", 9).alias("rank"))


# ---- stores and exports ----


@query("doc_store_hydrate", f"WITH {C_SQL} SELECT conv_id, turn, array_to_string(CASE WHEN conv_id % 2 = 0 AND len(kps) > 0 THEN kps ELSE ['own'] END, '/') AS keyphrases FROM c")
def _(s, d):
    c = _c(s, d).select(F.concat(F.lit("f"), "conv_id").alias("filename"), F.col("turn").alias("chunk_index"), "kps", "conv_id")
    docs = c.groupBy("filename", "conv_id").agg(F.count("*").alias("n")).select("filename", "conv_id", F.concat(F.lit("text "), "n").alias("content"))
    stored = docs.select("filename", F.when(F.col("conv_id") % 2 == 0, F.col("content")).otherwise("changed since").alias("content"))
    store = graphs.store_rows(c.select("filename", "chunk_index", F.col("kps").alias("keyphrases")), stored)
    out = graphs.hydrate(c.select("filename", "chunk_index", "conv_id", F.array(F.lit("own")).alias("keyphrases")), docs, store)
    return out.select("conv_id", F.col("chunk_index").alias("turn"), F.array_join("keyphrases", "/").alias("keyphrases"))


@query("beir_corpus", f"WITH {C_SQL} SELECT CAST(id AS VARCHAR) AS _id, coalesce(role, '') AS title, md5(text) AS text_md5, doc AS source, turn AS chunk_index FROM c")
def _(s, d):
    rows = exports.beir_corpus(_c(s, d).select(F.col("id").alias("chunk_id"), F.col("role").alias("section_title"), F.col("text").alias("content"), F.col("doc").alias("filename"), F.col("turn").alias("chunk_index")))
    return rows.select("_id", "title", _digest(F.col("text")).alias("text_md5"), "metadata.source", "metadata.chunk_index")
