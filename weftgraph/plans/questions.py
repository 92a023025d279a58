"""Queries of triplets, scenarios, questions and datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import qa as Q
from weftgraph.operators import scenario as S
from weftgraph.plans.chunks import C_SQL, JACC, NEXT_SQL, _c, _next
from weftgraph.plans.core import _digest, _t, query
from weftgraph.sources import exports, graphs

T_SQL = f"{C_SQL}, {NEXT_SQL}, t AS (SELECT e.*, CASE a % 3 WHEN 0 THEN 'agent_discovered' WHEN 1 THEN 'cosine_similarity' ELSE 'contains' END AS type FROM e)"


def _edges(s, d):
    k = F.col("a") % 3
    return _next(s, d).withColumn("type", F.when(k == 0, "agent_discovered").when(k == 1, "cosine_similarity").otherwise("contains"))


def _triplets(s, d):
    chunks = _c(s, d).withColumn("is_subdivision", F.col("turn") >= 2).withColumn("breadcrumb", F.when(F.col("turn") >= 2, "X").otherwise(F.col("role")))
    return S.find_triplets(_edges(s, d), chunks, "id", ["doc", "text", "kps", "is_subdivision", "breadcrumb"], G.SEMANTIC)


@query("triplets", f"WITH {T_SQL} SELECT a, b, type, doc_a, doc_b FROM t WHERE type <> 'contains'")
def _(s, d):
    return _triplets(s, d).select("a", "b", "type", "doc_a", "doc_b")


@query("same_section_filter", f"WITH {T_SQL} SELECT a, b FROM t WHERE type <> 'contains' AND a % 100 < 2")
def _(s, d):
    return S.of_different_sections(_triplets(s, d)).select("a", "b")


@query("inter_doc_filter", f"WITH {T_SQL} SELECT a, b FROM t WHERE type <> 'contains' AND (doc_a IS NULL OR doc_b IS NULL)")
def _(s, d):
    from weftgraph.operators.enrich import of_different_documents

    return _triplets(s, d).filter(of_different_documents(F.col("doc_a"), F.col("doc_b"))).select("a", "b")


@query("validator_filter", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL OR quality = 1")
def _(s, d):
    rows = _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels"), "doc_id", "left")
    return rows.filter(S.not_rejected(F.col("quality") == 1)).select("doc_id")


@query("triplet_quality", f"WITH {T_SQL} SELECT a, b FROM t WHERE type <> 'contains' AND {JACC} <= 0.20")
def _(s, d):
    return S.similar_enough_apart(_triplets(s, d)).select("a", "b")


@query("structural_fallback", "SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT p_partkey FROM part) AND o_custkey IN (SELECT p_partkey FROM part)")
def _(s, d):
    edges = _t(s, d, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), F.when(F.col("o_orderstatus") == "F", "next").otherwise("other").alias("type"))
    parts = _t(s, d, "part")
    none = S.find_triplets(edges, parts, "p_partkey", [], G.SEMANTIC)
    return S.structural_triplets(none, edges, parts, "p_partkey", []).select("a", "b")


@query("node_terms", f"WITH {C_SQL}, x AS (SELECT id, unnest(list_concat([upper(role), ' '], kps)) AS t FROM c) SELECT id, count(DISTINCT lower(t)) AS n FROM x WHERE trim(t) <> '' GROUP BY id")
def _(s, d):
    return _c(s, d).select("id", F.size(S.node_terms(F.array(F.upper("role"), F.lit(" ")), F.col("kps"))).cast("bigint").alias("n"))


@query("combinations", "WITH o AS (SELECT p_partkey AS k, p_type, p_size, CASE WHEN p_size % 2 = 0 THEN 'small' ELSE 'none' END AS combo FROM part), x AS (SELECT k, combo, CASE WHEN combo = 'small' THEN ['two'] ELSE ['one', 'two'] END AS who FROM o) SELECT k, combo AS combination, unnest(who) AS persona, CASE WHEN combo = 'small' THEN 1 ELSE 2 END AS n_nodes FROM x")
def _(s, d):
    combo = F.when(F.col("p_size") % 2 == 0, "small").otherwise("none")
    rows = _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.array(F.array(combo)).alias("combos"), F.lit("A").alias("a"), F.lit("B").alias("b"), F.array(F.lit("Small")).alias("terms_a"), F.array(F.lit("x")).alias("terms_b"))
    people = s.createDataFrame([("one", ["econ"]), ("two", ["Small"])], "persona string, concepts array<string>")
    out = S.prepare_combinations(rows, "k", "combos", people, ["misspelled", "odd"], ["short"])
    return out.select("k", F.array_join("combination", "/").alias("combination"), "persona", F.size("nodes").alias("n_nodes"))


@query("sample_one")
def _(s, d):
    return S.sample_one(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")


@query("qualify_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'comparison' WHEN 'O' THEN 'factual/integration' ELSE 'factual' END AS types FROM orders")
def _(s, d):
    got = S.qualify_types(F.col("o_orderstatus"), {"F": ["comparison", "odd"]}, {"O": ["odd"], "F": ["factual"]}, F.array(F.lit("factual")), ["factual", "integration", "comparison"])
    got = F.when(F.col("o_orderstatus") == "O", F.array_except(got, F.array(F.lit("comparison")))).otherwise(got)
    return _t(s, d, "orders").select("o_orderkey", F.array_join(got, "/").alias("types"))


@query("parse_types", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'factual/comparison' WHEN 1 THEN 'integration' ELSE 'factual' END AS types FROM orders")
def _(s, d):
    k = F.col("o_orderkey") % 3
    reply = F.when(k == 0, '```json\n["factual", "Comparison", "odd"]\n```').when(k == 1, '{"compatible_types": ["integration"], "why": "factual"}').otherwise('I think "factual" fits, "really"')
    return _t(s, d, "orders").select("o_orderkey", F.array_join(S.parse_types(reply, ["factual", "integration", "comparison"]), "/").alias("types"))


@query("qualify_requests", "SELECT conv_id, turn, md5(substr(text, 1, 30)) AS context_1, md5('') AS context_2 FROM conversations")
def _(s, d):
    rows = _t(s, d, "conversations").select("conv_id", "turn", F.array(F.concat(F.lit("<1-hop>\n"), "text")).alias("contexts"))
    out = S.qualify_requests(rows, "contexts", 30)
    return out.select("conv_id", "turn", _digest(F.col("context_1")).alias("context_1"), _digest(F.col("context_2")).alias("context_2"))


@query("scenario_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 50")
def _(s, d):
    return S.limited(_t(s, d, "orders"), ["o_orderpriority", "o_orderkey"], 50).select("o_orderkey")


@query("checkpoint_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)")
def _(s, d):
    ident = lambda c: S.scenario_id(F.lit("v1"), F.col(c)).alias("id")
    done = _t(s, d, "lineitem").filter("l_linenumber = 5").select(ident("l_orderkey")).distinct()
    return S.not_done(_t(s, d, "orders").select("o_orderkey", ident("o_orderkey")), done, "id").select("o_orderkey")


@query("budget_rebuild", "SELECT k AS kind, count(o_orderkey) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('none')) v(k) LEFT JOIN orders ON o_orderpriority = k GROUP BY k")
def _(s, d):
    budget = s.createDataFrame([("1-URGENT", 0.5), ("2-HIGH", 0.3), ("none", 0.2)], "kind string, target double")
    return S.rebuilt_counts(_t(s, d, "orders").select(F.col("o_orderpriority").alias("kind")), "kind", budget)


# ---- questions ----


@query("filename_propagation", "SELECT conv_id * 100 + turn AS node, CASE WHEN turn = 0 THEN 'own' ELSE 'f' || conv_id END AS filename FROM conversations")
def _(s, d):
    c = _c(s, d)
    nodes = c.select(F.col("id").alias("node"), F.when(F.col("turn") == 0, "own").otherwise("").alias("filename"))
    docs = c.select(F.col("conv_id").alias("node"), F.concat(F.lit("f"), "conv_id").alias("filename")).distinct()
    edges = c.select(F.col("conv_id").alias("a"), F.col("id").alias("b"), F.lit("contains").alias("type"), F.col("turn").alias("order"))
    return Q.with_filenames(nodes, docs, edges)


@query("source_documents", f"WITH {T_SQL} SELECT a, b, CASE WHEN doc_a IS NULL AND doc_b IS NULL THEN '' WHEN doc_a IS NULL THEN doc_b WHEN doc_b IS NULL OR doc_a = doc_b THEN doc_a ELSE doc_a || '/' || doc_b END AS documents FROM t WHERE type <> 'contains'")
def _(s, d):
    none = F.lit(None).cast("string")
    hop = lambda x: F.struct(F.lit("").alias("filename"), none.alias("metadata_filename"), F.col(f"doc_{x}").alias("parent_doc"), none.alias("known_as"))
    return _triplets(s, d).select("a", "b", F.array_join(Q.source_documents(F.array(hop("a"), hop("b"))), "/").alias("documents"))


@query("pair_dedupe_seeded", "WITH k AS (SELECT least(l_partkey, l_suppkey) AS x, greatest(l_partkey, l_suppkey) AS y, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2) SELECT x, y, seq FROM k WHERE NOT (x % 2 = 0 AND y % 2 = 1)")
def _(s, d):
    rows = _t(s, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    done = rows.filter("least(l_partkey, l_suppkey) % 2 = 0 and greatest(l_partkey, l_suppkey) % 2 = 1").select(F.col("l_suppkey").alias("l_partkey"), F.col("l_partkey").alias("l_suppkey")).distinct()
    return Q.seeded_pairs(rows, "l_partkey", "l_suppkey", "seq", done).select(F.least("l_partkey", "l_suppkey").alias("x"), F.greatest("l_partkey", "l_suppkey").alias("y"), "seq")


@query("hop_contexts", f"WITH {T_SQL} SELECT a, b, md5('[Semantic link: why ' || a || ']' || chr(10) || chr(10) || '<1-hop>' || chr(10) || substr('crumb' || chr(10) || chr(10) || text_a, 1, 100)) AS first, md5('<2-hop>' || chr(10) || substr(text_b, 1, 100)) AS second FROM t WHERE type <> 'contains'")
def _(s, d):
    one, two = [F.struct(F.col(f"text_{x}").alias("raw"), F.lit("").alias("page"), F.lit(crumb).alias("breadcrumb")) for x, crumb in (("a", "crumb"), ("b", ""))]
    ctx = Q.hop_contexts(F.array(one, two), F.concat(F.lit("why "), F.col("a").cast("string")), 100)
    return _triplets(s, d).select("a", "b", ctx.alias("c")).select("a", "b", _digest(F.get("c", F.lit(0))).alias("first"), _digest(F.get("c", F.lit(1))).alias("second"))


@query("empty_contexts", "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def _(s, d):
    body = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("  ")
    rows = _t(s, d, "conversations").filter(F.length("text") > 0).withColumn("c", F.array(F.lit("<1-hop>\n"), F.concat(F.lit("<2-hop>\n"), body)))
    return rows.filter(Q.has_context(F.col("c"))).select("conv_id", "turn")


J_SQL = "s AS (SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS g, 1 - least(1.0, greatest(0.0, value / 400)) AS acc, (user_id % 10) / 9.0 AS a, (event_id % 7) / 6.0 AS b FROM events)"


def _judged(s, d):
    return _t(s, d, "events").select("event_id", *[v.alias(k) for k, v in G.judge(F.col("value") / 100, F.col("value") / 400, (F.col("user_id") % 10) / 9.0, (F.col("event_id") % 7) / 6.0).items()])


@query("module_signals", f"WITH {J_SQL} SELECT event_id, CAST(round(a * 1e6) AS BIGINT) || '/' || CAST(round(g * 1e6) AS BIGINT) AS query_signal, CAST(round(g * 1e6) AS BIGINT) || '/' || CAST(round(acc * 1e6) AS BIGINT) || '/' || CAST(round(b * 1e6) AS BIGINT) AS answer_signal FROM s")
def _(s, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 1e6).cast("bigint")), "/")
    return _judged(s, d).select("event_id", text(F.col("query_signal")).alias("query_signal"), text(F.col("answer_signal")).alias("answer_signal"))


@query("judge_feedback", f"WITH {J_SQL} SELECT event_id, array_to_string(list_filter([CASE WHEN a < 0.8 THEN 'question_needs_both: one is enough' END, CASE WHEN g < 0.8 THEN '{Q.QUESTION_GROUNDED}' END], lambda x: x IS NOT NULL), ' | ') AS question_feedback, array_to_string(list_filter([CASE WHEN g < 0.8 THEN '{Q.ANSWER_GROUNDED}' END, CASE WHEN acc < 0.8 THEN '{Q.ANSWER_SPECIFIC}' END], lambda x: x IS NOT NULL), ' | ') AS answer_feedback FROM s")
def _(s, d):
    said = F.when(F.get("query_signal", F.lit(0)) < 0.8, "one is enough")
    fb = Q.feedback(F.col("groundedness_score"), F.col("answer_accuracy_score"), F.col("two_hop_score"), said, F.lit(""))
    return _judged(s, d).select("event_id", fb["question_feedback"].alias("question_feedback"), fb["answer_feedback"].alias("answer_feedback"))


@query("judge_missing", f"WITH {J_SQL} SELECT event_id, event_id % 3 = 0 OR (g >= 0.8 AND acc >= 0.8 AND (a + b) / 2 >= 0.8) AS passed, true AS passed_off FROM s")
def _(s, d):
    rows = _judged(s, d)
    on = Q.evaluated(True, F.col("event_id") % 3 == 0, {"passed": F.col("passed")})
    off = Q.evaluated(False, F.lit(False), {"passed": F.col("passed"), "two_hop_score": F.col("two_hop_score")})
    return rows.select("event_id", on["passed"].alias("passed"), off["passed"].alias("passed_off"))


@query("retry_loop", "WITH a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt, o_orderstatus = 'F' AS passed FROM orders), b AS (SELECT * FROM a WHERE attempt <= 3 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY passed DESC, CASE WHEN passed THEN attempt ELSE -attempt END) = 1) SELECT o_custkey, CAST(attempt AS INTEGER) AS attempts, NOT passed AS validator_rejected FROM b")
def _(s, d):
    from pyspark.sql import Window

    rows = _t(s, d, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("attempt"), (F.col("o_orderstatus") == "F").alias("passed"))
    return Q.last_attempts(rows, "o_custkey", "attempt", "passed").select("o_custkey", "attempts", "validator_rejected")


@query("type_distribution", "SELECT o_orderpriority AS kind, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_passed, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) FILTER (WHERE o_orderstatus <> 'P'), 6) AS pass_rate FROM orders GROUP BY 1")
def _(s, d):
    passed = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return Q.type_distribution(_t(s, d, "orders").select(F.col("o_orderpriority").alias("kind"), passed.alias("passed")), "kind", "passed").select("kind", "n", "n_passed", F.round("pass_rate", 6).alias("pass_rate"))


@query("pagination", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def _(s, d):
    return Q.page(_t(s, d, "orders").withColumn("p", -F.col("o_totalprice")), ["p", "o_orderkey"], 3).select("o_orderkey")


@query("score_counts", f"WITH {J_SQL} SELECT count(*) FILTER (WHERE least(g, acc, (a + b) / 2) >= 0.5) AS n_above, count(*) AS n FROM s")
def _(s, d):
    least, _mean = Q.overall([F.col(c) for c in ("groundedness_score", "answer_accuracy_score", "two_hop_score")])
    return Q.count_above(_judged(s, d), least, 0.5)


@query("compare_runs", "SELECT o_orderstatus AS run, count(*) AS n, round(count(*) FILTER (WHERE o_orderkey % 2 = 0) / count(*), 6) AS pass_rate, round(avg(o_totalprice), 2) AS mean_score FROM orders GROUP BY 1")
def _(s, d):
    rows = _t(s, d, "orders").select(F.col("o_orderstatus").alias("run"), (F.col("o_orderkey") % 2 == 0).alias("passed"), F.col("o_totalprice").alias("score"))
    return Q.compare_runs(rows, "run", "passed", ["score"]).select("run", "n", F.round("pass_rate", 6).alias("pass_rate"), F.round("mean_score", 2).alias("mean_score"))


# ---- exports ----


def _questions(s, d):
    score = lambda k: F.round(F.col(k), 6).alias(k)
    evals = F.struct(*[score(k) for k in ("groundedness_score", "answer_accuracy_score", "two_hop_score")]).alias("qa_eval")
    e = _judged(s, d)
    return e.select(
        F.col("event_id").alias("question_id"), F.concat(F.lit("q "), "event_id").alias("question"), F.lit("r").alias("reference"), F.array(F.lit("c1")).alias("reference_contexts"),
        F.array(F.col("event_id") % 50, F.col("event_id") % 7).alias("node_ids"), F.array(F.lit("d")).alias("source_documents"), F.lit("factual").alias("question_type"), F.lit("p").alias("persona"), evals,
    )


@query("beir_queries", "SELECT CAST(event_id AS VARCHAR) AS _id, 'q ' || event_id AS text, 'factual' AS type, 'p' AS persona FROM events")
def _(s, d):
    return exports.beir_queries(_questions(s, d)).select("_id", "text", "metadata.type", "metadata.persona")


@query("beir_qrels", "SELECT DISTINCT CAST(event_id AS VARCHAR) AS query_id, CAST(unnest([event_id % 50, event_id % 7]) AS VARCHAR) AS corpus_id, CAST(1 AS INTEGER) AS score FROM events")
def _(s, d):
    return exports.beir_qrels(_questions(s, d))


@query("dataset_csv", f"WITH {J_SQL} SELECT CAST(event_id AS VARCHAR) AS question_id, 'q ' || event_id AS question, 'c1' AS context_1, '' AS context_2, CAST(event_id % 7 AS VARCHAR) AS chunk_id_2, CAST(round((round(g, 6) + round(acc, 6) + round((a + b) / 2, 6)) * 1e6) AS BIGINT) AS thrice_overall FROM s")
def _(s, d):
    return exports.dataset_csv(_questions(s, d)).select("question_id", "question", "context_1", "context_2", "chunk_id_2", F.round(F.col("qa_overall") * 3e6).cast("bigint").alias("thrice_overall"))


@query("dataset_header", "SELECT 'v2.0' AS version, 'x' AS domain, count(*) AS num_questions FROM events")
def _(s, d):
    return exports.dataset_header(_t(s, d, "events"), domain="x").drop("created_at")


@query("graph_metadata", "SELECT (SELECT count(*) FROM orders) AS num_nodes, (SELECT count(*) FROM lineitem) AS num_relationships, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS documents")
def _(s, d):
    nodes = _t(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "DOCUMENT").otherwise("CHUNK").alias("type"))
    return graphs.graph_metadata(nodes, _t(s, d, "lineitem")).select("num_nodes", "num_relationships", F.col("node_types")["DOCUMENT"].alias("documents"))
