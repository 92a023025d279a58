"""Rows that share a doc_id but not a text: one node of the graph, with the links of each text."""

import random

from weftgraph.llm import minhash


def test_texts_of_one_id_keep_their_links(spark):
    rng = random.Random(3)
    text = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for g in range(12):
        a, b = text(80), text(80 if g % 2 else 90)  # equal and unequal sizes
        i = 10 * g
        rows += [(i, a), (i, b), (i + 1, [*a[:-1], "other"]), (i + 2, [*b[:-1], "other"]), (i + 3, text(80))]
        want |= {i: i, i + 1: i, i + 2: i, i + 3: i + 3}
    # 205 has the text of 200, that of 207 and an empty one
    a, b = text(80), text(80)
    rows += [(200, a), (205, a), (205, b), (205, []), (207, b)]
    want |= {200: 200, 205: 200, 207: 200}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = minhash.near_groups(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, c, i == c) for i, c in want.items()}
    assert {(r.doc_id, r.n_shingles) for r in got if r.doc_id == 205} == {(205, 76), (205, 0)}
