"""Operators without SQL, boundaries of the rules, files, and the annotation boundary."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import annotate as A
from weftgraph import config as C
from weftgraph.functions import arrays
from weftgraph.functions import text as T
from weftgraph.operators import enrich as E
from weftgraph.operators import graph as G
from weftgraph.operators import markdown as M
from weftgraph.operators import qa as Q
from weftgraph.operators import scenario as S
from weftgraph.operators import similarity as X
from weftgraph.sources import exports, files, graphs, sessions
from weftgraph.streaming import ingest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("step", "text", "want"),
    [
        (T.fix_heading_levels, "## Background\n## My title\n## 1.2.3.4 Deep\n## Other", "## Background\n# My title\n#### 1.2.3.4 Deep\n## Other"),
        (T.strip_page_lines, "see Page 3 of the big book\nPage 3 of 9\nkeep", "\nkeep"),
        (T.strip_technical_links, "[write @ us](mailto:a@b.c), [a@b.c](mailto:a@b.c)", "write @ us, "),
        (T.strip_footnotes, " * note\n*bold*", "\n*bold*"),
        (T.remove_affiliations, "# T\nDoe 1 University\na@b.cd\nreal text\n## Abstract\na@b.cd", "# T\nreal text\n## Abstract\na@b.cd"),
        (T.morph_normalize, "author's note", "author's note"),
        (T.clean_reply, "Summary: One. Two! Three? Four.", "One. Two! Three?"),
        (T.strip_trailing_sections, "a \n\n### Appendix B\nb", "a\n"),
    ],
)
def test_text_steps(spark, step, text, want):
    assert one(spark, step, text) == want


def test_cleaning_twice_changes_nothing(spark):
    text = "A &amp; b ﬁx\r\n\r\n\r\n\r\n## Title\nPage 3\nbody co-\nop [x](mailto:x@y.z)\n## References\nx"
    once = one(spark, lambda c: T.clean_markdown(c, F.lit("my_doc")), text)
    assert once == "A & b fix\n\n# Title\n\nbody coop x" and one(spark, lambda c: T.clean_markdown(c, F.lit("my_doc")), once) == once


def test_images(spark):
    big = "QUJD" * 1000
    text = f"Figure 2: the whole pipeline\n![image](data:image/png;base64,{big})<!-- image -->![](data:image/png;base64,QQ==)![c](data:image/png;base64,{big})"
    got = spark.createDataFrame([(text,)], "x string").select(T.replace_images(F.col("x"), F.array(F.lit("d0"), F.lit("d1"), F.lit("d2")), 1)).first()[0]
    assert got == "Figure 2: the whole pipeline\n> 📷 **Figure 2** : d0> 📷 [Figure 3 — limite atteinte]"


def test_running_sum(spark):
    values = [random.Random(1).randrange(9) for _ in range(300)]
    assert one(spark, arrays.running_sum, values, "array<bigint>") == [sum(values[:k]) for k in range(300)]
    assert one(spark, arrays.running_sum, [], "array<bigint>") == []


def test_chunks_of_a_document(spark):
    text = "start here\n# A\n" + "w " * 25 + "\n## B\nx y\n```\n# no\n```\n# C\nz"
    got = M.chunks(spark.createDataFrame([(1, text)], "d long, t string"), "d", "t", 10, 0.1, 2).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.section_title, r.breadcrumb, r.token_count, r.is_subdivision) for r in got] == [
        (0, "Introduction", "Introduction", 2, False), (1, "A", "A", 10, True), (2, "A", "A", 10, True), (3, "A", "A", 7, True), (4, "B", "A > B", 7, False),
    ]
    assert got[-1].merged_titles == ["B", "C"] and "# no" in got[-1].content


def test_sections_of_many_headings(spark):
    rng = random.Random(2)
    levels = [rng.randrange(1, 5) for _ in range(200)]
    text = "\n".join(f"{'#' * n} h{k}\nbody" for k, n in enumerate(levels))
    stack, want = [], []
    for k, n in enumerate(levels):
        stack = [x for x in stack if x[0] < n] + [(n, f"h{k}")]
        want.append(" > ".join(x[1] for x in stack))
    got = M.sections(spark.createDataFrame([(1, text)], "d long, t string"), "d", "t").orderBy("section").collect()
    assert [r.breadcrumb for r in got] == want


def test_no_shuffle_in_text_operators(spark):
    df = spark.createDataFrame([(1, "# a\nb")], "d long, t string")
    for out in (M.sections(df, "d", "t"), M.chunks(df, "d", "t"), M.table_rows(df, "d", "t"), M.drop_repeated_lines(df, "d", "t"), M.lines(df, "d", "t")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


# ---- similarity ----


def test_jaccard_join_against_all_pairs(spark):
    rng = random.Random(3)
    sets = {i: set(rng.sample(range(40), rng.randrange(1, 12))) for i in range(80)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "d long, x long")
    for least in (0.2, 0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b) for r in X.jaccard_join(rows, "d", "x", least).collect()} == want


def test_cosine_band_against_all_pairs(spark):
    rng = random.Random(4)
    vecs = {i: [rng.gauss(0, 1) + (3 if i % 4 == k else 0) for k in range(6)] for i in range(150)}
    vecs[200], vecs[201] = [0.0] * 6, [2 * x for x in vecs[0]]
    df = spark.createDataFrame([(i, v) for i, v in vecs.items()], "i long, v array<double>")

    def cos(a, b):
        na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0

    for low, high in ((0.6, 0.9), (-0.2, 0.2)):
        want = {(a, b) for a in vecs for b in vecs if a < b and low <= cos(vecs[a], vecs[b]) <= high}
        assert {(r.a, r.b) for r in X.cosine_band(df, "i", "v", low, high, block_rows=16).collect()} == want


def test_similar_phrases_against_all_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(120)} | {"martha", "marhta", "dixon", "dicksonx", "a b"})
    assert round(X.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(X.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    got = {(r.x, r.y) for r in X.similar_phrases(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    assert got == {(x, y) for x in words for y in words if X.jaro_winkler(*sorted((x, y))) >= 0.9}


def test_fuzzy_pairs_are_one_to_one(spark):
    df = spark.createDataFrame([(["red big cat", "red big cat!", "dog"], ["big red cat", "dogs"])], "a array<string>, b array<string>")
    assert [tuple(m) for m in df.select(X.fuzzy_pairs(F.col("a"), F.col("b"))).first()[0]] == [("red big cat", "big red cat", "red big cat")]


def test_anti_duplicate_boundary(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e"), (3, "a b c x")], "n long, t string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [(r.a, r.b) for r in X.anti_duplicate(pairs, texts, "n", "t").collect()] == [(1, 3)]  # 0.8 goes


# ---- enrichment, scenarios, questions ----


def test_frames(spark):
    rows = [(1, "x", 0, "Router core", "routes packets", "the data", "always"), (2, "y", 0, "router", "routes packets", "n/a", "fast"), (3, "y", 0, "other", "routes packets", "n/a", "z"), (4, "x", 0, "router core", "routes packets", "q", "q")]
    df = spark.createDataFrame(rows, "node long, doc string, i int, subject string, operation string, object string, result string")
    assert [tuple(r) for r in E.frame_overlap_join(df, "node", "doc", "i").orderBy("a", "b").collect()] == [(1, 2, "router"), (2, 4, "router")]
    frames = [{"subject": "the value", "operation": "is"}, {"subject": "cache", "operation": "is"}]
    kept = one(spark, lambda c: E.kept_frames(c), frames, "array<struct<subject:string,operation:string>>")
    assert [f.subject for f in kept] == ["cache"]


def test_entity_edges_make_chains(spark):
    rows = [(i, f"d{i}", "term") for i in range(5)] + [(i, f"d{i}", "rare") for i in (1, 3)] + [(20 + i, "e", f"x{i}") for i in range(10)]
    got = E.entity_edges(spark.createDataFrame(rows, "n long, d string, e string"), "n", "d", "e").orderBy("a", "b").collect()
    assert [(r.a, r.b, r.entity) for r in got] == [(0, 1, "term"), (1, 2, "term"), (1, 3, "rare"), (2, 3, "term"), (3, 4, "term")]


def test_pagerank(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 5)], "a long, b long")
    ranks = {r.node: r["rank"] for r in E.pagerank(edges, "a", "b", rounds=40).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[0] > 0.4 and abs(ranks[1] - ranks[4]) < 1e-12


def test_theme_registry_and_missing_types(spark):
    rows = spark.createDataFrame([("t", i) for i in range(40)] + [("u", 1), ("u", 1)], "theme string, doc long")
    got = {}
    for r in E.theme_registry(rows, "theme", "doc").collect():
        got.setdefault((r.theme, r.n_docs), []).extend(r.doc_ids)
    assert sorted(got[("t", 40)]) == list(range(40)) and got[("u", 1)] == [1]
    edges = spark.createDataFrame([("contains",), ("llm_triplet",)], "type string")
    assert E.missing_semantic_types(edges, ["llm_triplet", "cosine_similarity"]) == ["cosine_similarity"]


def test_filters_that_would_leave_nothing(spark):
    rows = spark.createDataFrame([(1, True, True, "x", "x")], "a long, is_subdivision_a boolean, is_subdivision_b boolean, breadcrumb_a string, breadcrumb_b string")
    assert S.of_different_sections(rows).count() == 1
    two = rows.unionByName(rows.withColumn("breadcrumb_b", F.lit("y")))
    assert S.of_different_sections(two).count() == 1


def test_pair_quality_boundary(spark):
    rows = [(1, 2, "a b c", "c d e"), (1, 3, "a b c", "b c d"), (1, 4, "a", " "), (None, 4, "a", "b")]
    df = spark.createDataFrame(rows, "a long, b long, text_a string, text_b string")
    assert [r.b for r in S.similar_enough_apart(df).collect()] == [2]  # 0.2 stays


def test_round_robin_order(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate("bbbabca")], "i int, t string")
    assert "".join(r.t for r in G.round_robin(df, "t", "i").collect()) == "abcabbb"


def test_request_size_and_sampling(spark):
    assert S.request_size(10) == 20 and S.request_size(10, 0.5, False) == 15 and S.request_size(2, 0.5, False) == 7
    df = spark.createDataFrame([(k, v) for k in "ab" for v in range(9)], "k string, v int")
    first = {tuple(r) for r in S.sample_one(df, "k").collect()}
    assert len(first) == 2 and first == {tuple(r) for r in S.sample_one(df.repartition(7), "k").collect()}


def test_contexts(spark):
    hops = [{"raw": "r" * 9, "page": "p", "breadcrumb": "A > B"}, {"raw": "", "page": "page", "breadcrumb": "C"}]
    df = spark.createDataFrame([(hops, "why")], "h array<struct<raw:string,page:string,breadcrumb:string>>, y string")
    assert df.select(Q.hop_contexts(F.col("h"), F.col("y"), 10)).first()[0] == ["[Semantic link: why]\n\n<1-hop>\nA > B\n\nrrr", "<2-hop>\npage"]
    assert not one(spark, Q.has_context, ["<1-hop>\n ", "<2-hop>\n"], "array<string>") and one(spark, Q.has_context, ["<1-hop>\n", "<2-hop>\nx"], "array<string>")


def test_signals_and_feedback(spark):
    cases = [(0.4, 0.9, 0.9, 0.7, 0.6), (0.0, 0.2, 0.2, 0.8, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0)]  # needs, ground, -, accuracy, uses
    df = spark.createDataFrame(cases, "a double, g double, g2 double, acc double, b double")
    j = G.judge(F.col("g"), 1 - F.col("acc"), F.col("a"), F.col("b"))
    got = df.select(j["query_signal"].alias("q"), j["answer_signal"].alias("s"), *[v.alias(k) for k, v in Q.feedback(j["groundedness_score"], j["answer_accuracy_score"], j["two_hop_score"], F.lit(None).cast("string"), F.lit(None).cast("string")).items()]).collect()
    assert got[0].q == [0.4, 0.9] and [round(x, 6) for x in got[0].s] == [0.9, 0.7, 0.6]
    assert got[2].feedback == got[2].question_feedback == got[2].answer_feedback == ""
    assert "two_hop: score 0.50" in got[1].feedback and Q.QUESTION_GROUNDED in got[1].question_feedback


def test_validator_with_null_confidence(spark):
    edges = spark.createDataFrame([(1,), (2,)], "e long")
    verdicts = spark.createDataFrame([(1, False, None), (2, False, 0.9)], "e long, is_reliable boolean, confidence double")
    assert [r.keeps for r in G.validate_edges(edges, verdicts, "e").orderBy("e").collect()] == [True, False]


# ---- annotation ----


def test_annotators(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    recorded = spark.createDataFrame([("a", 7)], "text string, score int").select(A.request_hash(F.col("text")).alias("request"), "score")
    assert [r.score for r in A.annotate(rows, ["text"], A.Recorded(recorded)).orderBy("id").collect()] == [7, None, 7]
    ruled = A.annotate(rows, ["text"], A.RuleBased(score=F.length("text")))
    assert [r.score for r in ruled.collect()] == [1, 1, 1]

    def call(batch):
        if any(r["text"] == "b" for r in batch):
            raise RuntimeError("bad request")
        return [{"score": len(r["text"])} for r in batch]

    called = A.annotate(rows, ["text"], A.Called("score int", call, batch=1, first_wait=0.0))
    assert [r.score for r in called.orderBy("id").collect()] == [1, None, 1]


def test_retries():
    waits, tries = [], []

    def call():
        tries.append(1)
        raise TimeoutError("Timed out")

    with pytest.raises(TimeoutError):
        A.with_retries(call, 4, 3.0, waits.append)
    assert waits == [3.0, 6.0, 12.0] and len(tries) == 4
    with pytest.raises(ValueError):
        A.with_retries(lambda: int("x"), 4, 3.0, waits.append)
    assert len(waits) == 3


# ---- configuration and files ----

CONFIG = {
    "taxonomy": {"types": [{"name": "factual"}, {"name": "integration"}], "budget": {"factual": 0.4, "integration": 0.6}, "relation_to_question_types": {r: ["factual"] for r in C.RELATIONS[:5]}},
    "personas": [{"name": "p", "role_description": "d"}],
    "prompts": {"qualify_user_template": "{context_1} {context_2}"},
}


def test_validate():
    assert C.validate(CONFIG) == []
    bad = C.update(CONFIG, {"taxonomy.budget.factual": 0.6, "evaluation.max_retry": -1, "kg_enrichment.cosine_sim_min": 0.9, "kg_enrichment.cosine_sim_max": 0.6, "prompts.qualify_user_template": "{context_1", "query_params.styles": ["odd"], "personas": []})
    assert {i.field for i in C.validate(bad) if i.severity == "error"} == {"taxonomy.budget", "evaluation.max_retry", "kg_enrichment", "prompts.qualify_user_template", "personas"}
    assert [i.field for i in C.validate(bad) if i.severity == "warning"] == ["query_params.styles"]


def test_migration():
    old = {"prompts": {"query_answer_generation": "x", "other": "o"}, "few_shots": {"query_answer_generation": [{"input": {"persona_name": "p", "themes": ["t"], "context": ["a", "b"]}, "output": {"query": "q", "answer": "w"}}]}}
    new = C.migrate(old)
    assert set(new["prompts"]) == {"other", "query_generation", "answer_generation"}
    assert new["few_shots"]["query_generation"] == [{"input": old["few_shots"]["query_answer_generation"][0]["input"], "output": {"query": "q"}}]
    assert new["few_shots"]["answer_generation"] == [{"input": {"context": ["a", "b"], "question": "q", "themes": ["t"]}, "output": {"answer": "w"}}]
    assert C.migrate(new) == new and "query_answer_generation" in old["prompts"]


def test_filters_and_prompts():
    only = C.allow_types(CONFIG, ["integration"])
    assert only["taxonomy"]["budget"] == {"integration": 1.0} and C.allow_types(CONFIG, ["odd"]) == CONFIG
    assert C.layered({"a": None, "b": 1}, {"a": 2}, {"a": 3, "c": 4}, {"d": 5}) == {"a": 2, "b": 1, "c": 4, "d": 5}
    assert C.keep_named(CONFIG["personas"], ["zz"], lambda p: p["name"]) == CONFIG["personas"]
    new, changed = C.resync_prompts({"prompts": {"a": "old", "qualify_system": "mine"}}, {"a": "new", "qualify_system": "theirs"})
    assert new["prompts"] == {"a": "new", "qualify_system": "mine"} and changed == ["a"]
    assert C.resolve_personas([{"input": {"persona_name": "p"}, "output": {}}], CONFIG["personas"])[0]["input"]["persona"]["role_description"] == "d"


def test_sessions_and_jobs(spark, tmp_path):
    box = sessions.Sessions(str(tmp_path / "s"))
    box.create("one", CONFIG)
    with pytest.raises(FileExistsError):
        box.create("one", {})
    box.fork("one", "two", {"evaluation.max_retry": 3})
    assert box.list() == ["one", "two"] and C.at(box.get("two"), "evaluation.max_retry") == 3 and box.get("two")["meta"]["forked_from"] == "one"
    box.delete("one")
    assert not box.exists("one")
    with pytest.raises(ValueError):
        box.get("../x")
    jobs = sessions.Jobs(str(tmp_path / "j"))
    job = jobs.submit("two")
    jobs.set(job["job_id"], "done", result_path="/r")
    with pytest.raises(ValueError):
        jobs.set(job["job_id"], "running")
    rows = spark.createDataFrame([("two", "a", 1.0, "/x"), ("two", "b", 2.0, "/y"), ("two", "c", 3.0, None)], "session_id string, job_id string, created_at double, result_path string")
    assert sessions.latest_result(rows, "two").first().result_path == "/y" and jobs.list()[0]["state"] == "done"


def test_conversion(spark, tmp_path):
    for name, data in (("a.md", b"# A"), ("b.txt", b"x \r\n\r\n\r\n\r\ny"), ("c.pdf", b"%"), ("d.docx", b"z"), ("e.md", b"\xff")):
        (tmp_path / name).write_bytes(data)
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    convert = lambda rows: rows.select("path", F.when(F.col("format") == "pdf", "## Made").alias("converted"))
    got = {r.path.rpartition("/")[2]: (r.name, r.content, r.error) for r in files.ensure_markdown(raw, convert).collect()}
    assert got["a.md"] == ("a.md", "# A", None) and got["b.txt"][1] == "# b\n\nx\n\ny" and got["e.md"][2] == "not UTF-8"
    assert got["c.pdf"][1] == "# Made" and got["c.pdf"][0].startswith("c_") and got["d.docx"][2] == "nothing converted"
    assert {r.path[-4:] for r in files.scan_files(spark, str(tmp_path / "a.md")).collect()} == {"a.md"}
    assert {r.sample for r in files.upload_samples(raw).collect()} >= {"# A", "[pdf file]"}
    docs = files.read_documents(spark.createDataFrame([("x", None), ("y", "n")], "content string, filename string"))
    assert [r.filename for r in docs.orderBy("content").collect()] == ["unknown", "n"]


def test_json_graph(spark, tmp_path):
    ident = "0F8FAD5B-D9CB-469F-A165-70867728950E"
    whole = {"nodes": [{"id": ident, "type": "document", "name": "d"}, {"id": "c1", "type": "DOCUMENT", "name": "c"}], "relationships": [{"source": ident.lower(), "target": "c1", "type": "x"}, {"source": "c1", "target": "gone", "type": "x"}]}
    (tmp_path / "g.json").write_text(json.dumps(whole))
    nodes, edges = graphs.read_json_graph(spark, str(tmp_path / "g.json"))
    assert {(r.id, r.type) for r in nodes.collect()} == {(ident.lower(), "CHUNK"), ("c1", "DOCUMENT")} and edges.count() == 1
    graphs.write_snapshot(nodes, edges, str(tmp_path), "kg_01_raw")
    assert graphs.read_graph(spark, str(tmp_path / "kg_01_raw"))[1].count() == 1
    with pytest.raises(ValueError):
        graphs.write_snapshot(nodes, edges, str(tmp_path), "odd")
    graphs.write_graph(nodes, edges, str(tmp_path / "lines"), "json")
    assert spark.read.json(str(tmp_path / "lines" / "metadata")).first().num_nodes == 2


def test_store_and_stages(spark, tmp_path):
    chunks = spark.createDataFrame([("f", 0, ["k"]), ("f", 2, [])], "filename string, chunk_index int, keyphrases array<string>")
    docs = spark.createDataFrame([("f", "text")], "filename string, content string")
    graphs.write_store(graphs.store_rows(chunks, docs, "512"), str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    fresh = chunks.withColumn("keyphrases", F.array(F.lit("own")))
    words = lambda d, p: [r.keyphrases for r in graphs.hydrate(fresh, d, store, p).orderBy("chunk_index").collect()]
    assert words(docs, "512") == [["k"], ["own"]] and words(docs, "1024") == [["own"], ["own"]]
    assert words(docs.withColumn("content", F.lit("new")), "512") == [["own"], ["own"]]
    assert graphs.read_stage(spark, str(tmp_path), "s", "a long").count() == 0
    graphs.write_stage(spark.range(3).withColumnRenamed("id", "a"), str(tmp_path), "s")
    assert graphs.read_stage(spark, str(tmp_path), "s", "a long").count() == 3


def test_datasets(spark, tmp_path):
    row = ("q1", "what, \"so\"?", "r", ["c1"], [1, 2], ["d"], "factual", "p", (0.5, 0.7, 0.9))
    schema = "question_id string, question string, reference string, reference_contexts array<string>, node_ids array<long>, source_documents array<string>, question_type string, persona string, qa_eval struct<groundedness_score:double,answer_accuracy_score:double,two_hop_score:double>"
    q = spark.createDataFrame([row], schema)
    exports.write_job_dataset(q, str(tmp_path), "s", "j")
    assert spark.read.json(str(tmp_path / "s" / "j" / "header")).first().num_questions == 1
    exports.write_csv(q, str(tmp_path))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "dataset")).first()
    assert back.question == row[1] and tuple(spark.read.option("header", True).csv(str(tmp_path / "dataset")).columns) == exports.CSV_COLUMNS and float(back.qa_overall) == pytest.approx(0.7)
    chunks = spark.createDataFrame([("1", "t", "c", "f", 0)], "chunk_id string, section_title string, content string, filename string, chunk_index int")
    exports.write_beir(chunks, q, str(tmp_path / "beir"))
    assert spark.read.json(str(tmp_path / "beir" / "qrels")).count() == 2 and spark.read.json(str(tmp_path / "beir" / "corpus")).first()["metadata"].source == "f"


def test_live_jobs_and_windows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in ([("j1", 1, "queued"), ("j2", 1, "queued")], [("j1", 2, "running")]):
        spark.createDataFrame(rows, "job string, at int, state string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("job string, at int, state string").parquet(src)
        ingest.live_jobs(stream, "job", "at", "state", out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.job, r.state) for r in spark.read.parquet(f"{out}/v=1").collect()) == [("j1", "running"), ("j2", "queued")]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a")], "t string, s string").withColumn("t", F.to_timestamp("t"))
    assert [r.n for r in ingest.stage_windows(events, "t", "s").collect()] == [2]


@pytest.mark.parametrize(("low", "terms"), [(0.05, 12), (0.7, 300)])
def test_cosine_terms_against_all_pairs(spark, low, terms):
    """A low band adds products up, a high one verifies what prefixes leave."""
    rng = random.Random(6)
    vecs = {}
    for i in range(60):
        base = random.Random(i % 12).sample(range(terms), 8)
        v = {t: rng.random() + 0.2 for t in base[: rng.randrange(3, 9)]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vecs[i] = {t: x / norm for t, x in v.items()}
    rows = spark.createDataFrame([(i, t, x) for i, v in vecs.items() for t, x in v.items()], "d long, t long, weight double")
    cos = lambda a, b: sum(x * vecs[b].get(t, 0.0) for t, x in vecs[a].items())
    want = {(a, b) for a in vecs for b in vecs if a < b and low <= cos(a, b) <= 0.99}
    assert {(r.a, r.b) for r in X.cosine_terms(rows, "d", "t", low, 0.99).collect()} == want
