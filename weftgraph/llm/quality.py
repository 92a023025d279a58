"""Quality: random-indexing word vectors pooled per document, then a two-layer numpy network.

Every token (a run of letters and digits, or a run of other visible bytes) has a sparse ternary index vector,
drawn by its hash, to which that of its shape is added. A token's context vector sums the index vectors
of its neighbours over the bounded labelled sample. A document is the mean of its
tokens' context and index vectors over the whole text, with how alike neighbouring tokens are and how far the
tokens agree as a whole. Two layers turn that into a logit; a temperature and a bias fitted on a third of
the sample, which training does not see, calibrate the probability.

Defined cases: null or empty text has no tokens and pools to zero; without labels of both classes
every score is 1 (nothing is known against a text); an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, labelled_sample, tidy
from weftgraph.llm.textbytes import AS_IS, SPACE, Spans, column_bytes, runs, slices

#: Labelled rows by class that training may use.
PER_CLASS = {0: 1500, 1: 2500}
THRESHOLD = 0.3
BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: Tokens whose vectors are held at once.
WINDOW_TOKENS = 1 << 18
HIDDEN, STEPS, BATCH, RATE = 32, 1500, 64, 0.01
SHAPES = 8

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = ~_WORD & ~SPACE
_UPPER, _DIGIT = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[65:91], _DIGIT[48:58] = 1, 1


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape of every token, and where each text's tokens begin."""
    kinds = _WORD[data], _MARK[data]
    spans = [runs(mask, at) for mask in kinds]
    begin, end = np.concatenate([x[0] for x in spans]), np.concatenate([x[1] for x in spans])
    mark = np.repeat([0, 1], [len(x[0]) for x in spans])
    order = np.argsort(begin, kind="stable")
    begin, end, mark = begin[order], end[order], mark[order]
    bucket = (Spans(data, AS_IS).of(begin, end) & np.uint64(BUCKETS - 1)).astype(np.int32)
    upper, digit = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _DIGIT))
    n_upper, n_digit, size = upper[end] - upper[begin], digit[end] - digit[begin], end - begin
    first = _UPPER[data[begin]] if len(begin) else np.zeros(0, np.int64)
    shape = np.select([mark == 1, n_digit == size, n_digit > 0, (n_upper > 1) & (2 * n_upper >= size), first == 1, size > 20], [1 + np.minimum(size - 1, 1), 3, 4, 5, 6, 7], 0)
    return bucket, shape.astype(np.int8), np.searchsorted(begin, at)


def index_vectors(seed: int = 11) -> np.ndarray:
    """Sparse ternary vectors of unit length for all buckets, then for all shapes."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + SHAPES, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(len(out)), rng.integers(0, DIM, len(out))] = rng.choice([-1.0, 1.0], len(out))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


@dataclass
class Network:
    index: np.ndarray
    context: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0
    shift: float = 0.0

    def features(self, bucket: np.ndarray, shape: np.ndarray, at: np.ndarray) -> np.ndarray:
        n, count = len(at) - 1, np.diff(at)
        out = np.zeros((n, 2 * DIM + SHAPES + 5), np.float32)
        if not len(bucket):
            return out
        filled = count > 0
        if len(bucket) <= WINDOW_TOKENS:
            full = self._per_token(bucket, shape, at)
            out[filled, : full.shape[1]] = np.add.reduceat(full, at[:-1][filled], axis=0) / count[filled, None]
        else:  # window after window: memory doesn't grow with the text
            for i in np.flatnonzero(filled):
                total = np.zeros(2 * DIM + SHAPES + 2)
                for a in range(at[i], at[i + 1], WINDOW_TOKENS):
                    b = min(at[i + 1], a + WINDOW_TOKENS)
                    lo, hi = max(at[i], a - 2), min(at[i + 1], b + 1)  # what the neighbours need
                    full = self._per_token(bucket[lo:hi], shape[lo:hi], np.array([0, hi - lo]))
                    total += full[a - lo : b - lo].sum(axis=0, dtype=np.float64)
                out[i, : len(total)] = total / count[i]
        out[:, -3] = (out[:, DIM : 2 * DIM] ** 2).sum(axis=1)
        out[:, -2] = np.log1p(count)
        out[:, -1] = 1 / (1 + count)
        return out

    def _per_token(self, bucket: np.ndarray, shape: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = self.index[bucket]
        near = np.zeros(len(bucket), np.float32)
        near[:-1] = np.einsum("nd,nd->n", own[:-1], own[1:])
        near[at[1:][np.diff(at) > 0] - 1] = 0
        same = np.zeros(len(bucket), np.float32)
        same[2:] = bucket[2:] == bucket[:-2]
        shapes = np.zeros((len(bucket), SHAPES), np.float32)
        shapes[np.arange(len(bucket)), shape] = 1
        return np.concatenate([self.context[bucket], own, shapes, near[:, None], same[:, None]], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, bucket: np.ndarray, shape: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = (self.logits(self.features(bucket, shape, at)) + self.shift) / self.temperature
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))).astype(np.float64), 6)


def context_vectors(index: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Unit sums of the index vectors around every bucket's occurrences."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for bucket, shape in texts:
        own = index[bucket] + index[BUCKETS + shape.astype(np.int64)]
        for d in range(1, WINDOW + 1):
            if len(bucket) > d:
                np.add.at(out, bucket[d:], own[:-d])
                np.add.at(out, bucket[:-d], own[d:])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Network | None:
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(texts)) % 3 == 0
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    index = index_vectors()
    net = Network(index, context_vectors(index, [t for t, h in zip(texts, held, strict=True) if not h]))
    x = np.concatenate([net.features(b, s, np.array([0, len(b)])) for b, s in texts])
    fit = ~held
    net.mean, net.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z = (x - net.mean) / net.scale
    params = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = np.flatnonzero(fit)
    for step in range(1, STEPS + 1):
        pick = rng.choice(rows, BATCH)
        xb, y = z[pick], labels[pick]
        a = xb @ params[0] + params[1]
        h = np.maximum(a, 0)
        g = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - y) / BATCH
        da = np.outer(g, params[2]) * (a > 0)
        for k, d in enumerate((xb.T @ da + 1e-4 * params[0], da.sum(axis=0), h.T @ g, g.sum(keepdims=True))):  # Adam
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.001 * (d * d - second[k])
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.layers = tuple(p.astype(np.float32) for p in params)
    check = held if held.any() else fit
    raw, y, best = net.logits(x[check]), labels[check], (np.inf, 1.0, 0.0)
    for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
        for shift in np.linspace(-2, 2, 17):
            v = (raw + shift) / t
            loss = float(np.mean(np.logaddexp(0, v) - y * v))
            if loss < best[0] - 1e-9:
                best = (loss, t, float(shift))
    net.temperature, net.shift = best[1], best[2]
    return net


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network | None:
    """Train on the labelled rows for which train_rows (of doc_id) holds."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = labelled_sample(rows, labels, label_col, train_rows, PER_CLASS)
    got = sample.select("doc_id", "label", F.arrow_udf(_token_ids, "binary")("text").alias("ids")).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    both = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("ids")]
    return train([(t >> 4, (t & 15).astype(np.int8)) for t in both], np.array(got.column("label").to_pylist(), np.int64))


@tidy
def _token_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in batches:
        data, at = column_bytes(col)
        out = []
        for lo, hi in slices(at):
            bucket, shape, cut = tokens(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            both = bucket << 4 | shape
            out += [both[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.array(out, pa.binary())


def score(docs: DataFrame, net: Network | None, text: Column) -> Column:
    """The score of each text; the network is a few MB whatever the corpus."""
    if net is None:
        return F.lit(1.0)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            data, at = column_bytes(col)
            parts = [shared.value.scores(*tokens(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])) for lo, hi in slices(at)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return F.arrow_udf(run, "double")(F.coalesce(text, F.lit("")))
