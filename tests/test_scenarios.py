from weftgraph.operators import scenario as S
from weftgraph.sources import files, graphs
from weftgraph.streaming import ingest


def test_budget():
    assert S.fit_budget({"a": 0.5, "b": 0.25, "c": 0.25}, ["b", "c"]) == {"b": 0.5, "c": 0.5}
    assert sum(S.fit_budget({"a": 1, "b": 1, "c": 1}).values()) == 1


def test_assign_types(spark):
    rows = [(1, i, t) for i, t in enumerate([["factual", "integration"], ["factual", "integration"], ["odd"], None, ["factual"]])]
    df = spark.createDataFrame(rows, "g int, ord int, types array<string>")
    got = S.assign_types(df, "g", "ord", "types", {"integration": 0.6, "factual": 0.4}).orderBy("ord").collect()
    assert [r.question_type for r in got] == ["integration", "factual", "odd", "integration", "factual"]


def test_assign_types_streams_sorted_groups(spark):
    rows = [(None if i % 7 == 0 else i % 7, i * 37 % 1000, [["factual"], ["factual", "integration"], [], ["odd", "x"]][i * i % 4]) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, ord int, types array<string>")
    budget = {"integration": 0.5, "factual": 0.5}
    want = {}
    for g in {r[0] for r in rows}:
        counts = dict.fromkeys(budget, 0)
        for _, o, types in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            known = [t for t in budget if t in types]
            want[o] = max(known, key=lambda t: budget[t] - counts[t] / max(1, sum(counts.values()))) if known else (types or ["integration"])[0]
            if want[o] in counts:
                counts[want[o]] += 1
    got = S.assign_types(df, "g", "ord", "types", budget)
    assert {r.ord: r.question_type for r in got.collect()} == want
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()  # a call into Python per group


def test_files_and_graph(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# A")
    (tmp_path / "in" / "sub" / "b.TXT").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "c.png").write_bytes(b"x")
    assert files.scan_files(spark, str(tmp_path / "in")).count() == 2
    got = {r.path[-5:]: r.content for r in files.read_markdown(spark, str(tmp_path / "in")).collect()}
    assert got == {"/a.md": "# A", "b.TXT": None}
    nodes = spark.createDataFrame([("1", "DOCUMENT"), ("2", "odd")], "id string, type string")
    edges = spark.createDataFrame([("1", "2"), ("1", "9")], "source string, target string")
    graphs.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = graphs.read_graph(spark, str(tmp_path / "g"))
    assert {r.type for r in n.collect()} == {"DOCUMENT", "CHUNK"} and e.count() == 1


def test_ingest_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for texts in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(t,) for t in texts], "text string").write.mode("append").parquet(src)
        ingest.ingest(ingest.new_documents(spark, src, "text string"), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
