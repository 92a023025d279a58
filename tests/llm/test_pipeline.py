"""corpus_pipeline.run against plain Python, stage by stage, and every query on empty tables."""

import hashlib
import random
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import bpe, toxicity
from weftgraph.llm.common import is_held_out
from weftgraph.llm.queries import QUERIES, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _mh_id int, row string, _tox_score string, _ld_id int, score int"
LINE = "this very line of more than forty code points is in many documents"


def documents():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    out = []
    for i in range(120):
        words = [word() for _ in range(rng.choice([3, 30, 60]))]
        if i % 5 == 0:
            words[len(words) // 2] = "idiot"
        text = " ".join(words)
        if i % 4 == 1:
            text = f"{text}\n {LINE.upper()}\t\nend {i}"
        out.append((i, text))
    out += [(200 + k, out[7 * k + 2][1]) for k in range(10)]  # copies
    out += [(220 + k, out[6 * k + 3][1] + " more") for k in range(10)]  # near ones
    out += [(300, None), (301, ""), (302, LINE), (302, LINE), (None, "no id at all")]
    return [(i, t, "en" if k % 3 else None, None if k % 11 == 0 else f"s{k % 3}", 1, 2, "r", "t", 3, 4) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("idiot" not in (t or "")), int("idiot" in (t or ""))) for i, t, *_ in documents() if i is not None and i < 120]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def lines_left(rows):
    fold = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(fold(x)) >= 40:
                held.setdefault(fold(x), set()).add(i)
    goes = {k: max(d, key=lambda i: (i is not None, i)) for k, d in held.items() if len(d) >= 5}
    return [(i, "\n".join(x for x in (t or "").split("\n") if fold(x) not in goes or goes[fold(x)] == i)) for i, t in rows]


def near_left(rows, words=5):
    parts = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    sets = []
    for i, t in rows:
        w = parts(t)
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return [r for r in rows if r[0] is None or root(r[0]) == r[0]]


def mixed(rows):
    """rows: id, text, source -> how often each is taken."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    h = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(own.values())
    while True:
        level = left / sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and level * weight[s] > 2 * own[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            left -= 2 * own[s]
    for s in names:
        target[s] = 2 * own[s] if s in full else level * weight[s]
    out = {}
    for s in names:
        passes = int(target[s] // max(1, own[s]))
        rest = int(target[s] - passes * own[s])
        before = 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: h(r[0])):
            part = max(0, min(size(t), rest - before))
            before += size(t)
            if size(t):
                out[i, s] = int((passes * size(t) + part) / size(t) + 0.5)
    return out


def test_run_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    net = toxicity.fit(docs, labels, ~is_held_out(F.col("doc_id"), 3, 1))
    scored = docs.select("doc_id", "text", "source", toxicity.score(docs, net, F.col("text")).alias("s"), toxicity.threshold(net, F.col("lang")).alias("line")).collect()
    kept = [(r.doc_id, r.text, r.source) for r in scored if r.s < r.line]
    toxic = {r.doc_id for r in scored if r.text and "idiot" in r.text}
    caught = toxic - {i for i, *_ in kept}
    assert len(caught) >= 0.9 * len(toxic) and len(scored) - len(kept) <= len(toxic) + 2
    source = {(i, k): s for k, (i, _, s) in enumerate(kept)}
    texts = lines_left([(i, t) for i, t, _ in kept])
    by_id = {}
    for k, (i, t) in enumerate(texts):
        by_id.setdefault(i, []).append((t, source[i, k]))
    near = near_left(texts)
    rows, used = [], {}
    for i, t in near:
        n = used[i] = used.get(i, -1) + 1
        rows.append((i, t, by_id[i][n][1]))
    coder = bpe.codec(P.path(TOKENIZER), P.PATTERN)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(coder.tokens)}, special_tokens={})
    copies = mixed(rows)
    want = sorted((str(i), str(s), tuple(known.encode_ordinary(t))) for i, t, s in rows if t.strip() for _ in range(copies.get((i, s), 0)) if i != 302)
    got = [r for r in corpus_pipeline.run(spark, folder).collect() if r.doc_id != 302]
    assert sorted((str(r.doc_id), str(r.source), tuple(r.token_ids)) for r in got) == want and len(want) > 50
    assert all(r.n_tokens == len(r.token_ids) for r in got)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        row = out.filter("doc_id = 10 or doc_id = 11").first()
        assert row is None or (row["_mh_id"], row["row"], row["_tox_score"], row["_ld_id"], row["score"]) == (2, "r", "t", 3, 4)


def test_queries_on_empty_tables(spark, tmp_path):
    schemas = {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in [*QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
        assert query(spark, str(tmp_path)).count() == 0, name
