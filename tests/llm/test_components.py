"""Small tables with nulls, empty and repeated texts, ties and clashing columns, against brute force."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftgraph.llm import bpe, exact_dedup, line_dedup, media, minhash, mixing, pii, quality, toxicity, warc

LONG = "this is a line of more than forty code points in all"
WORDS = [f"w{i}" for i in range(60)]
TEXTS = [
    (1, None), (2, ""), (3, "a b"), (4, "a b"), (5, " ".join(WORDS)), (6, " ".join([*WORDS[:-1], "other"])), (7, "\n" * 5),
    *[(10 + i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend é") for i in range(6)], (20, "mail a.b@c.de ip 1.2.3.4 card 4111 1111 1111 1111 call +1 (555) 123-4567"),
    (30, "é" * 70000), (31, "x" * 100000), (10, f"own 0\n  {LONG}\t\nend é"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size int, kept string, fp string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 5 else f"s{i % 3}", 1, "k", "f", 2) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_lines(docs, empty):
    got = {r["doc_id"]: r for r in rows(line_dedup.dedup_lines(docs))}
    assert {i for i, r in got.items() if r["_ld_n_dropped"]} == {10, 11, 12, 13, 14}
    assert got[11]["_ld_text"] == "own 1\nend é" and got[15]["_ld_n_dropped"] == 0
    assert got[1]["_ld_n_lines"] == 1 and got[7]["_ld_n_lines"] == 6
    assert line_dedup.deduped_documents(docs).columns == docs.columns
    assert rows(line_dedup.deduped_documents(empty)) == []


def test_exact(docs, empty):
    got = rows(exact_dedup.exact_groups(docs))
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["keep_id"] == 2 and by[3]["keep_id"] == 4 and by[3]["group_size"] == 2
    assert sum(r["kept"] for r in got if r["doc_id"] == 10) == 1
    assert by[2]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows(exact_dedup.exact_groups(empty)) == []


def test_fingerprints_compose(spark):
    data = bytes(np.random.default_rng(1).integers(32, 127, 3 * exact_dedup.CHUNK + 77, dtype=np.uint8))
    df = spark.createDataFrame([(1, data.decode()), (2, ""), (3, data[: exact_dedup.CHUNK].decode())], "doc_id long, text string")
    for r, text in zip(exact_dedup.fingerprints(df).orderBy("doc_id").collect(), (data, b"", data[: exact_dedup.CHUNK]), strict=True):
        want = []
        for p, b in zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True):
            h = 0
            for x in text:
                h = (h * b + x + 1) % p
            want.append(h)
        assert r.fp == want[0] << 31 | want[1] and r.n_bytes == len(text)


def test_equal_fingerprints_of_unequal_texts_are_split(spark, monkeypatch):
    made = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d: made(d).withColumn("fp", F.lit(5).cast("long")))
    texts = [(1, "aa"), (2, "ab"), (3, "aa"), (4, "b"), (None, "ab")]
    got = exact_dedup.exact_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(1, 3, 2, False), (3, 3, 2, True), (2, 2, 2, True), (None, 2, 2, False), (4, 4, 1, True)}


def _pivot_pairs(spark, sets, pivot):
    """Pairs by differences from a pivot, all pairs of different components, and the linked ones of these."""
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    component = [0 if near(s, pivot) else i + 1 for i, s in enumerate(sets)]
    held = [(i, len(s), -1, len(pivot), component[i], len(s ^ pivot), sorted(s ^ pivot)) for i, s in enumerate(sets)]
    around = spark.createDataFrame(held, "rep long, n long, pivot long, pn long, component long, d long, diff array<long>")
    got = {(r.a, r.b) for r in minhash._sharing_differences(minhash._placed(around, 80), 80).collect()}
    every = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if component[a] != component[b]}
    return got, every, {(a, b) for a, b in every if near(sets[a], sets[b])}


def test_pairs_by_differences_lose_no_link(spark):
    """Edited copies of one text, of many lengths, some with edits in common."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 40, 60)
    sets = []
    for i in range(120):
        s = base.copy()
        s[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(1, 30, 1)[0] if i % 3 else i * 1000 + rng.integers(1, 9)
        if i % 4 == 0:
            s[:12] = np.arange(100, 112)
        sets.append(set(map(int, s[: 60 - i % 7])))
    got, every, linked = _pivot_pairs(spark, sets, set(map(int, base)))
    assert linked and linked <= got <= every and len(got) < len(every)


def test_pairs_by_differences_of_a_large_group(spark):
    """Copies too far from each other to link, with most of the text in common, of many lengths, make few pairs."""
    rng = np.random.default_rng(6)
    base = rng.integers(1, 1 << 40, 100)
    sets = []
    for i in range(150):
        s = base.copy()
        s[rng.choice(90, 15, replace=False)] = rng.integers(1, 1 << 40, 15)
        sets.append(set(map(int, s[: 100 - i % 9])))
    got, every, linked = _pivot_pairs(spark, sets, set(map(int, base)))
    assert linked <= got and 20 * len(got) < len(every)



def test_near(docs, empty):
    got = {r["doc_id"]: r for r in rows(minhash.near_groups(docs, words=4))}
    assert got[6]["component_id"] == 5 and not got[6]["kept"] and got[5]["kept"]
    assert got[1] | {"kept": 0} == {"doc_id": 1, "n_shingles": 0, "component_id": 1, "kept": 0}
    assert got[4]["component_id"] == 3 and got[3]["n_shingles"] == 1
    assert minhash.one_of_each(docs).columns == docs.columns
    assert rows(minhash.near_groups(empty)) == []


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 1 << 63, 1200, dtype=np.uint64)
    s = minhash.sketches([np.unique(x[:1000]), np.unique(x[200:]), x[:1]])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15


def test_mixing(docs, empty):
    got = rows(mixing.mix_sources(docs))
    assert len(got) == len(TEXTS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert rows(mixing.mix_sources(empty)) == []


def test_bpe(spark, docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = bpe.codec(path, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder.prepare()
    for _, t in TEXTS:
        assert coder.plain(t or "").tolist() == known.encode_ordinary(t or "")
    spaced = bpe.Codec(coder.tokens, r"\S+|\s+")  # any other pattern goes by the regular expression
    spaced.prepare()
    other = tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    data = "one two,three 44".encode()
    ids, _, back = next(iter(spaced.rows(np.frombuffer(data, np.uint8), np.array([0, len(data)]))))
    assert ids.tolist() == other.encode_ordinary(data.decode()) and back.tobytes() == data
    for r in rows(docs.select("text", bpe.token_digests(spark, F.col("text"), coder).alias("d"))):
        ids = known.encode_ordinary(r["text"] or "")
        assert r["d"]["n_tokens"] == len(ids) and r["d"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["d"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert rows(empty.select(bpe.token_digests(spark, F.col("text"), coder).alias("d"))) == []


def test_media(docs, empty):
    known = dict(TEXTS)
    for r in rows(media.media_features(docs)):
        data = media.pad((known[r["doc_id"]] or "").encode())
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["payload_bytes"] == len(data)
        assert r["tail_crc32"] == zlib.crc32(data[-32:]) and r["n_bytes"] == len((known[r["doc_id"]] or "").encode())
        stored = media.encode(data)
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        rgb = media.tensor(media.decode(stored))
        assert (r["height"], r["width"]) == rgb.shape[:2] and bytes(r["rgb"]) == rgb.tobytes() and r["feature"] == media.feature(rgb)
    assert rows(media.media_features(empty)) == []


def test_tensors_come_in_batches_of_bounded_size():
    stored = [media.encode(media.pad(bytes([k]) * (150_000 if k else 2_000_000))) for k in range(20)]
    got = list(media._read_media(iter([pa.array(stored), pa.array([], pa.binary())])))
    sizes = [r["media_bytes"] for b in got for r in b.to_pylist()]
    assert sizes == [len(x) for x in stored] and len(got) > 4
    assert all(len(b) == 1 or sum(r["media_bytes"] for r in b.to_pylist()) <= 1 << 20 for b in got)


def test_rgb_against_a_plain_inverse_transform():
    """Every sample by the defining double sum, chroma repeated, colours by the standard's matrix."""
    image = media.decode(media.encode(media.pad(bytes(range(256)) * 3)))
    got = media.tensor(image).astype(int)
    planes = []
    for c in image.components.values():
        plane = np.zeros((8 * c.high, 8 * c.wide))
        for n, block in enumerate(c.coef):
            f = np.zeros(64)
            f[media.ZIGZAG] = block * image.quants[c.quant]
            f = f.reshape(8, 8)
            k = np.arange(8)
            basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, 2**-0.5, 1)[None, :]
            y, x = divmod(n, c.wide)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(np.rint(basis @ f @ basis.T / 4 + 128), 0, 255)
        planes.append(plane.repeat(image_v(image) // c.v, axis=0).repeat(image_h(image) // c.h, axis=1)[: image.height, : image.width])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    assert np.abs(got - np.clip(np.rint(want), 0, 255)).max() <= 1


def image_v(image):
    return max(c.v for c in image.components.values())


def image_h(image):
    return max(c.h for c in image.components.values())


def test_slow_scans_agree(monkeypatch):
    payload = media.pad(np.random.default_rng(5).bytes(3000))
    fast = media.decode(media.encode(payload))
    monkeypatch.setattr(media, "_whole_scan", lambda *a: False)
    slow = media.decode(media.encode(payload))
    assert all((a.coef == b.coef).all() for a, b in zip(fast.components.values(), slow.components.values(), strict=True))


def test_pii(docs, empty):
    got = {r["doc_id"]: r for r in rows(pii.personal_data(docs))}
    text = dict(TEXTS)[20]
    spans = [(s["start"], s["end"]) for s in got[20]["base_spans"]]
    assert [text[a:b] for a, b in spans] == ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    assert got[1]["all_spans"] == [] and rows(pii.personal_data(empty)) == []


def test_classifiers(spark, docs, empty):
    toxic = [(100 + i, f"plain words here {i} " + ("idiot " if i % 2 else "friend ") + "and more", "en") for i in range(80)]
    df = spark.createDataFrame(toxic, ["doc_id", "text", "lang"])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _, _ in toxic], ["doc_id", "toxic", "quality"])
    net = toxicity.fit(df, labels, F.lit(True))
    scored = {r["doc_id"]: r["s"] for r in rows(df.select("doc_id", toxicity.score(df, net, F.col("text")).alias("s")))}
    assert all((s >= 0.5) == bool(i % 2) for i, s in scored.items())
    assert all(0 <= r["s"] <= 1 for r in rows(docs.select(toxicity.score(docs, net, F.col("text")).alias("s"))))
    q = quality.fit(df, labels, F.lit(True))
    assert all(0 <= r["s"] <= 1 for r in rows(docs.select(quality.score(docs, q, F.col("text")).alias("s"))))
    assert toxicity.fit(empty, labels, F.lit(True)) is None and quality.fit(docs, labels.limit(0), F.lit(True)) is None
    assert toxicity.clean_documents(docs, labels, F.lit(True)).columns == docs.columns


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/é b", "same", 0), (2, None, "same", 0), (3, "http://c", None, 0), (4, "http://d", "", 0), (None, "http://e", "x", 0)], "page_id long, url string, html string, len int")
    got = {r["page_id"]: r for r in rows(warc.archived_pages(pages))}
    assert (got[2]["record_type"], got[2]["refers_to"], got[1]["record_type"]) == ("revisit", 1, "response")
    assert got[4]["refers_to"] == 3 and got[3]["payload_bytes"] == 0 and len(got) == 5
    assert got[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode() and re.fullmatch("[A-Z2-7]{32}", got[3]["payload_digest"])
    assert rows(warc.archived_pages(pages.limit(0))) == []
