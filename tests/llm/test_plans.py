"""What the executed plans hold."""

from pyspark.sql import functions as F

from weftgraph.llm import line_dedup


def test_first_occurrences_are_streamed_from_one_sorted_range(spark):
    line = "a line of text that has more than forty code points"
    docs = spark.createDataFrame([(i, f"{line}\nown\n{line}") for i in range(20)], "doc_id long, text string")
    lines = line_dedup.occurrences(docs, 40)
    keys = line_dedup.repeated_keys(lines, 5)
    assert [(r.n_docs, r.keeper) for r in keys.collect()] == [(20, 19)]
    plan = keys._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "rangepartitioning" in final and "Window" in final and "Sort [h1" in final
    # the window takes the range exchange as it is: between it and the range there is no other exchange
    between = final[final.index("Window") : final.index("rangepartitioning")]
    assert between.count("hashpartitioning") == 0 and "pos" in between


def test_stored_bitmaps_are_runs(spark):
    line = "a line of text that has more than forty code points"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}\nb\n{line}\nend") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: [tuple(k) for k in r.keep] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert got == {i: [(1, 2), (4, 1)] for i in range(5)}
    assert line_dedup.keep_bitmaps(docs).select(F.sum("n_dropped")).first()[0] == 10
