"""The classifiers on labelled documents that they were not trained on, long texts, and the training sample's bound."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common, quality, toxicity
from weftgraph.llm.queries import op2_toxicity, op6_quality

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize(("query", "label", "recall", "false"), [(op2_toxicity, "toxic", 0.88, 0.01), (op6_quality, "quality", 0.97, 0.05)])
def test_held_out(spark, query, label, recall, false):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    got = query(spark, DATA).filter("held_out").join(labels, "doc_id").select("y", "predicted", "score").toPandas()
    assert len(got) > 500 and got.score.between(0, 1).all()
    assert got.predicted[got.y == 1].mean() >= recall and got.predicted[got.y == 0].mean() <= false


def test_windows_change_no_score(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in rng.integers(0, 400, 3000)).encode()
    texts = [text, b"", text[:100]]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ids, cut = toxicity.hashed_words(data, at)
    net = toxicity.Network(*[rng.normal(0, 1, s).astype(np.float32) for s in ((toxicity.BUCKETS, toxicity.DIM), (toxicity.DIM, 48), 24, 24)], 0.1)
    tokens = quality.tokens(data, at)
    other = quality.Network(quality.index_vectors(), rng.normal(0, 1, (quality.BUCKETS, quality.DIM)).astype(np.float32))
    want, features = net.logits(ids, cut), other.features(*tokens)
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    monkeypatch.setattr(quality, "WINDOW_TOKENS", 64)
    assert np.allclose(net.logits(ids, cut), want, atol=1e-4)
    assert np.allclose(other.features(*tokens), features, atol=1e-4)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a", "x")] * 50 + [(1, "b", "y")] * 50 + [(2, "é" * common.LONGEST, "z"), (3, "c", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", F.lit(True), {0: 5, 1: 5}).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and set(got[0].asDict()) == {"doc_id", "label", "text", "lang"}
