"""Links of near_groups against plain Python sets of words; texts that algebraic hashes confuse; skewed groups."""

import random
import re

import pytest

from weftgraph.llm import minhash


def thue_morse(n, one, zero):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_texts_with_equal_power_sums_are_apart(spark):
    a, b = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    short = "".join(thue_morse(64, "x", "y")), "".join(thue_morse(64, "y", "x"))
    df = spark.createDataFrame(enumerate([a, b, *short, f"{a} 1 2 3", f"{b} 1 2 3"], 1), "doc_id long, text string")
    got = minhash.near_groups(df, words=4).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == 6


def brute(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_components_against_all_pairs(spark, seed):
    """A large group of edited copies of one text, some far from it but near each other, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice(['w', 'W', 'é'])}{rng.randrange(5000)}"
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(70):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 8])):
            own[rng.randrange(80)] = word()
        if rng.random() < 0.3:
            own[10:30] = base[30:50]
        texts.append(own)
    texts += [[word() for _ in range(rng.choice([1, 3, 40]))] for _ in range(30)] + [[], ["a", "b"], ["A", "b"]]
    rows = [(7 * i + 1, " \t".join(t)) for i, t in enumerate(texts)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for words in (4, 5):
        got = minhash.near_groups(df, words=words).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, words, 80)
