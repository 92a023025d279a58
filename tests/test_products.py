"""Products of sparse rows block by block, against all pairs; and that no operator on top of them shuffles pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.operators import enrich as E
from weftgraph.operators import graph as G
from weftgraph.operators import products as P
from weftgraph.operators import similarity as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_blocks_by_number():
    assert [P.pair_of(k) for k in range(6)] == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert [P.pair_of(k) for k in (10**12 - 1, 10**12)] == [next((i, k - i * (i + 1) // 2) for i in range(1414212, 1414216) if i * (i + 1) // 2 <= k < (i + 1) * (i + 2) // 2) for k in (10**12 - 1, 10**12)]


@pytest.mark.parametrize(("terms", "stripe", "chunk", "dense"), [(6, 16, 50, 400), (40, 7, 13, 1), (4000, 16, 50, 0.001)])
def test_products_against_all_pairs(spark, monkeypatch, terms, stripe, chunk, dense):
    for k, v in {"STRIPE": stripe, "CHUNK": chunk, "DENSE": dense}.items():
        monkeypatch.setattr(P, k, v)
    rng = random.Random(terms)
    rows = {i: {rng.randrange(terms): rng.randrange(1, 5) * 1.0 for _ in range(rng.randrange(1, 9))} for i in range(120)}
    df = spark.createDataFrame([(f"d{i}", t, w, float(len(r))) for i, r in rows.items() for t, w in r.items()], "d string, t long, weight double, n double")
    want = {}
    for i in rows:
        for j in rows:
            k = sum(w * rows[j][t] for t, w in rows[i].items() if t in rows[j])
            if f"d{i}" < f"d{j}" and k >= 3:
                want[f"d{i}", f"d{j}"] = (k, len(rows[i]), len(rows[j]))
    # the stripes of two blocks, in this process where the sizes above hold
    table = lambda some: P.Block([pa.table({"d": [f"d{i}" for i in some], "n": [float(len(rows[i])) for i in some], "ts": pa.array([list(rows[i]) for i in some], pa.list_(pa.int64())), "ws": [list(rows[i].values()) for i in some]})])
    x, y = table(range(70)), table(range(70, 120))
    met = [(i.as_py(), j.as_py(), k) for u, v in ((x, x), (y, y), (x, y)) for at, to, ks in P._met(u, v, u is v, lambda k, x, y: k >= 3, np.float64) for i, j, k in zip(u.ids.take(pa.array(at)), v.ids.take(pa.array(to)), ks, strict=True)]
    assert {(min(i, j), max(i, j)): k for i, j, k in met} == {p: w[0] for p, w in want.items()} and len(met) == len(want)
    for entries in (10**6, 150):
        got = P.products(df, lambda k, x, y: k >= 3, block_entries=entries)
        assert {(r.a, r.b): (r.k, r.n_a, r.n_b) for r in got.collect()} == want and got.count() == len(want)


def common(rng, n=200):
    """Every set holds most of a few common items: all pairs share some."""
    return {i: set(rng.sample(range(12), 9)) | {100 + rng.randrange(300) for _ in range(20)} for i in range(n)}


def test_jaccard_of_common_items_shuffles_no_pairs(spark):
    sets = common(random.Random(2))
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "d long, x long")
    got = X.jaccard_join(rows, "d", "x", 0.2)
    assert {(r.a, r.b) for r in got.collect()} == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.2}
    assert "Join" not in plan(got) and "Exchange" not in plan(got)


def test_cosine_of_common_terms_shuffles_no_pairs(spark):
    sets = common(random.Random(3))
    rows = spark.createDataFrame([(i, x, 1 / len(s) ** 0.5) for i, s in sets.items() for x in s], "d long, t long, weight double")
    got = X.cosine_terms(rows, "d", "t", 0.251, 0.349)
    want = {(a, b): len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5 for a in sets for b in sets if a < b}
    assert {(r.a, r.b): round(r.cosine, 9) for r in got.collect()} == {p: round(c, 9) for p, c in want.items() if 0.251 <= c <= 0.349}
    assert "Join" not in plan(got) and "Exchange" not in plan(got)


@pytest.mark.parametrize("items", [True, False])
def test_keyphrase_overlap_of_common_phrases(spark, items):
    sets = {i: {str(x) for x in s} for i, s in common(random.Random(4)).items()}
    # rows of one node are one chunk
    rows = [(i, sorted(s)[:15]) for i, s in sets.items()] + [(i, sorted(s)[10:]) for i, s in sets.items()]
    got = X.keyphrase_overlap_join(spark.createDataFrame(rows, "n long, p array<string>"), "n", "p", score=0.012, exact=True, items=items)
    want = {(a, b): sets[a] & sets[b] for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) >= 0.012}
    assert {(r.a, r.b): r.n_matches for r in got.collect()} == {p: len(s) for p, s in want.items()} and want
    if items:
        assert {(r.a, r.b): [x.x for x in r.overlapped_items] for r in got.collect()} == {p: sorted(s) for p, s in want.items()}
    else:
        assert "Join" not in plan(got) and "Exchange" not in plan(got)


def test_shared_pairs_of_common_items_shuffle_no_pairs(spark):
    sets = common(random.Random(5))
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "d long, x long")
    got = G.shared_pairs(rows, "d", "x", 8)
    assert {(r.a, r.b): r.shared for r in got.collect()} == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 8}
    assert "Join" not in plan(got) and "Exchange" not in plan(got)


def test_bridge_pairs_deal_more_tasks_to_more_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "TASK_ROWS", 10)
    rows = [(i // 4, i % 3, i % 4, i * 7 % 5) for i in range(200)]
    got = E.bridge_pairs(spark.createDataFrame(rows, "g long, d long, p long, n long"), "g", "d", "p", "n")
    want = {(g, x, y) for g, _, p, x in rows for h, _, q, y in rows if g == h and p < q and x != y}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and "hashpartitioning(g#" in plan(got) and ", 20)" in plan(got)


def test_cosine_band_sends_no_vector_to_every_pair(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(100)], "i long, v array<double>")
    got = plan(X.cosine_band(df, "i", "v", 0.6, 0.9, block_rows=16))
    assert "Join" not in got and "Exchange" not in got
