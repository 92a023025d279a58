import pytest

from weftgraph.functions import text as T
from weftgraph.operators import graph as G
from weftgraph.operators import markdown as M


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(("word", "want"), [("queries", "query"), ("classes", "class"), ("types", "typ"), ("running", "runn"), ("mixed", "mix"), ("pass's", "pass")])
def test_morph(spark, word, want):
    assert one(spark, T.morph_normalize(M.F.col("x")), x=word) == want


def test_fence_and_breadcrumb(spark):
    text = "# A\n```\n# x\n```\n## B\nb\n### C\nc\n## D\nd\n# E\ne"
    df = spark.createDataFrame([(1, text)], ["doc_id", "md"])
    got = [(r.level, r.breadcrumb) for r in M.sections(df, "doc_id", "md").orderBy("section").collect()]
    assert got == [(1, "A"), (2, "A > B"), (3, "A > B > C"), (2, "A > D"), (1, "E")]


def test_merge_and_split(spark):
    df = spark.createDataFrame([(1, "# a\nx x x\n# b\nx x x\n# c\nx x x x x")], ["doc_id", "md"])
    got = M.merge_small(df, "doc_id", "md", 6).orderBy("chunk_index").collect()
    assert [(r.title, r.token_count) for r in got] == [("a", 6), ("c", 5)]
    words = spark.createDataFrame([(1, " ".join(map(str, range(19))))], ["doc_id", "text"])
    parts = M.split_long(words, "doc_id", "text", 10).orderBy("piece").collect()
    assert [(r.piece, r.token_count) for r in parts] == [(0, 10), (1, 10), (2, 1)]


def test_repeated_lines(spark):
    rows = "\n".join(x for n in (5, 6, 79, 80) for x in [chr(96 + n % 20 + 1) * n] * 3)
    got = M.drop_repeated_lines(spark.createDataFrame([(1, rows)], ["doc_id", "text"]), "doc_id", "text").first()
    assert got.n_removed == 6


def test_idf_boundary(spark):
    rows = spark.createDataFrame([(c, "half") for c in (1, 2)] + [(c, "most") for c in (1, 2, 3)] + [(4, "rare")], ["chunk", "phrase"])
    assert {r.phrase for r in G.idf_prune(rows, "chunk", "phrase").collect()} == {"half", "rare"}


def test_judge(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 0.3, 1.3, 1.0), (1.0, nan, 0.5, 1.0)], ["g", "a", "b", "c"])
    got = df.select(*[v.alias(k) for k, v in G.judge(*[M.F.col(c) for c in "gabc"]).items()]).collect()
    assert [(r.groundedness_score, round(r.answer_accuracy_score, 6), r.two_hop_score) for r in got] == [(0.0, 0.7, 1.0), (1.0, 0.0, 0.75)]
    assert [r.question_is_faulty for r in got] == [False, True]


def test_target_prefix_and_validator(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([True, False, None, True])], "q int, ord int, passed boolean")
    assert [r.ord for r in G.target_prefix(df, "q", "ord", "passed", 2).orderBy("ord").collect()] == [0, 1, 2]
    edges = spark.createDataFrame([(1,), (2,), (3,)], ["e"])
    verdicts = spark.createDataFrame([(2, False, 0.49), (3, False, 0.5)], ["e", "is_reliable", "confidence"])
    assert [r.keeps for r in G.validate_edges(edges, verdicts, "e").orderBy("e").collect()] == [True, True, False]
