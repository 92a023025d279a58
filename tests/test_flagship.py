"""The flagship query against plain Python over all pairs of chunks."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from weftgraph.operators import graph as G
from weftgraph.plans import catalog


def brute(sets, k):
    """sets: {chunk: words}; the document of a chunk is what stands before its colon."""
    sets = {c: s for c, s in sets.items() if s}
    df = Counter(w for s in sets.values() for w in s)
    kept = {c: {w for w in s if len(sets) <= 1 or math.log(len(sets) / df[w]) >= 0.693} for c, s in sets.items()}
    pairs = [(a, b, len(kept[a] & kept[b])) for a, b in combinations(sorted(kept), 2) if a.split(":")[0] != b.split(":")[0]]
    return sorted([p for p in pairs if p[2]], key=lambda p: (-p[2], p[0], p[1]))[:k]


def write(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("long", [False, True])
def test_flagship_counts_groups_of_more_than_20(spark, tmp_path, long):
    rng, tail = random.Random(5), "abcdefghijkl" if long else ""
    word = lambda i: f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{tail}"
    copy = [word(i) for i in range(60)]
    texts = [(i, " ".join(copy)) for i in range(25)] + [(30 + i, " ".join([*copy[: 58 - i], *[word(200 + 3 * i + j) for j in range(2 + i)]])) for i in range(6)]
    texts += [(40 + i, " ".join([*[word(rng.randrange(100, 500)) for _ in range(60)], "12345", "of"])) for i in range(40)]
    write(spark, tmp_path, texts)
    sets = {f"{i}:0": {w for w in t.split() if len(w) >= 3 and not w.isdigit()} for i, t in texts}
    got = [tuple(r) for r in catalog.flagship(spark, str(tmp_path)).collect()]
    assert got == brute(sets, 20) and got[0][2] == 60


@pytest.mark.parametrize("seed", range(2))
def test_top_shared_pairs(spark, seed):
    rng = random.Random(seed)
    pool = [f"i{k}" for k in range(rng.choice([6, 30, 200]))]
    bases = [rng.sample(pool, rng.randrange(1, min(len(pool), 25))) for _ in range(12)]
    sets = {}
    for n in range(90):
        base = set(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 3])):
            base ^= {rng.choice(pool)}
        sets[f"{rng.randrange(1, rng.choice([3, 40]))}:{n}"] = base
    rows = spark.createDataFrame([(c, c.split(":")[0], sorted(s)) for c, s in sets.items()], "chunk string, doc string, items array<string>")
    pairs = [(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if a.split(":")[0] != b.split(":")[0]]
    for k in (3, 20):
        want = sorted([p for p in pairs if p[2]], key=lambda p: (-p[2], p[0], p[1]))[:k]
        assert [tuple(r) for r in G.top_shared_pairs(rows, "chunk", "doc", "items", k).collect()] == want


def test_too_common_is_what_idf_prune_drops(spark):
    sets = {1: ["half", "most"], 2: ["half", "most"], 3: ["most"], 4: ["rare"], 5: []}
    rows = spark.createDataFrame(list(sets.items()), "c int, items array<string>")
    flat = spark.createDataFrame([(c, w) for c, s in sets.items() for w in s], "c int, w string")
    left = {r.w for r in G.idf_prune(flat, "c", "w").collect()}
    assert set(G.too_common(rows, "items")) == {w for s in sets.values() for w in s} - left == {"most"}
