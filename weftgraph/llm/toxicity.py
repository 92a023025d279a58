"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one hashed table: the word's own and those of its first
four and five bytes, so that inflected forms share what they begin with. Filters of several
widths slide over the words of the whole text, each is max-pooled and rectified, and a logistic
layer gives the score. Training passes gradients only through the pooled positions (Adagrad). The labelled
sample is bounded by PER_CLASS and reduced to hashed words on the executors; a part of it sets the bias and
the thresholds by language. Neither language nor any other column is an input of a score.

Defined cases: null or empty text has no words and gets the score of the bias alone; without
labels of both classes every score is 0; a language that was not calibrated has the threshold
THRESHOLD; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, labelled_sample, tidy
from weftgraph.llm.textbytes import Spans, column_bytes, runs, slices

#: Labelled rows by class that training may use.
PER_CLASS = {1: 1500, 0: 3500}
THRESHOLD = 0.7
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
PREFIXES = (4, 5)
#: Texts that must hold a row of the table; weight of the classes' share in what a row says, in texts.
LEAST, PRIOR = 3, 5
#: Words whose embeddings and filters are held at once.
WINDOW = 1 << 18
#: One in so many texts is kept back from training, for bias, temperature and thresholds.
HELD = 4
#: Gradient steps at least, in whole passes over the sample.
STEPS, BATCH, RATE = 450, 64, 0.08

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_COLS = [sum(WIDTHS[:i]) * FILTERS for i in range(len(WIDTHS))]


def hashed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for every word of all texts (n x 3), and where each text's words begin."""
    begin, end = runs(_WORD[data], at)
    hashes = Spans(data)
    ids = np.empty((len(begin), 1 + len(PREFIXES)), np.int32)
    ids[:, 0] = hashes.of(begin, end) & np.uint64(BUCKETS - 1)
    for k, size in enumerate(PREFIXES, 1):
        # hashes hold the length, so a word shorter than the prefix falls on its own row
        ids[:, k] = (hashes.of(begin, np.minimum(end, begin + size)) >> np.uint64(20 + k)) & np.uint64(BUCKETS - 1)
    return ids, np.searchsorted(begin, at)


@dataclass
class Network:
    table: np.ndarray
    filters: np.ndarray  # DIM x (sum(WIDTHS) * FILTERS)
    offset: np.ndarray
    out: np.ndarray
    bias: float
    temperature: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, at: np.ndarray, after: int = 0):
        """Per text the rectified maxima, and the words where they were found; the last `after` words begin nothing."""
        n, pad = len(at) - 1, max(WIDTHS) - 1
        size = len(ids) + n * pad
        where = np.arange(len(ids)) + np.repeat(np.arange(n) * pad, np.diff(at))
        e = np.zeros((size, DIM), np.float32)
        e[where] = self.table[ids].sum(axis=1)
        held = np.zeros(size, bool)
        held[where[: len(where) - after]] = True
        parts = e @ self.filters
        best, found = np.empty((n, len(WIDTHS) * FILTERS), np.float32), np.empty((n, len(WIDTHS) * FILTERS), np.int64)
        starts = at[:-1] + np.arange(n) * pad
        for k, (width, col) in enumerate(zip(WIDTHS, _COLS, strict=True)):
            act = parts[:, col : col + FILTERS].copy()
            for j in range(1, width):
                act[:-j] += parts[j:, col + j * FILTERS : col + (j + 1) * FILTERS]
            act[~held] = -np.inf
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            best[:, own] = np.maximum.reduceat(act, starts, axis=0)
            found[:, own] = -1
            if self.track:
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], size], strict=True)):
                    found[i, own] = a + act[a:b].argmax(axis=0)
        best += self.offset
        best[~np.isfinite(best)] = 0
        return np.maximum(best, 0), found, e, where

    track = False

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        if len(ids) <= WINDOW:
            return self.pooled(ids, at)[0] @ self.out + self.bias
        best = np.stack([self._windowed(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
        return best @ self.out + self.bias

    def _windowed(self, ids: np.ndarray) -> np.ndarray:
        """The maxima of one text, window after window: its memory doesn't grow with the text."""
        best, reach = np.zeros(len(self.out), np.float32), max(WIDTHS) - 1
        for a in range(0, max(1, len(ids)), WINDOW - reach):
            own = ids[a : a + WINDOW]
            more = a + WINDOW < len(ids)
            np.maximum(best, self.pooled(own, np.array([0, len(own)]), reach if more else 0)[0][0], out=best)
            if not more:
                break
        return best

    def scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(ids, at) / self.temperature, -30, 30))), 6)


def class_lead(samples: list[np.ndarray], labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """By how much each row of the table speaks for class 1, from the texts that hold it; NaN where under LEAST do.

    Rows of few texts get no vector, so that training can't learn single texts by their own words.
    """
    held = np.zeros((2, BUCKETS))
    for i in rows:
        held[labels[i], np.unique(samples[i])] += 1
    share = labels[rows].mean()
    posterior = (held[1] + PRIOR * share) / (held.sum(axis=0) + PRIOR)
    lead = np.log(posterior / (1 - posterior)) - np.log(share / (1 - share))
    lead[held.sum(axis=0) < LEAST] = np.nan
    return lead / 3


def train(samples: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Network | None:
    """samples: hashed words (n x 3) of each text."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(samples)) % HELD == 0
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    lead = class_lead(samples, labels, fit)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    table[np.isnan(lead)] = 0
    table[:, 0] = np.nan_to_num(lead)
    filters = rng.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    for k, (width, col) in enumerate(zip(WIDTHS, _COLS, strict=True)):  # half of each width's filters begin with the lead
        filters[0, col : col + width * FILTERS] = 0
        for j in range(width):
            filters[0, col + j * FILTERS : col + j * FILTERS + FILTERS // 2] = 1 / width
        out[k * FILTERS : k * FILTERS + FILTERS // 2] = 0.25
    net = Network(table, filters, np.zeros(len(out), np.float32), out, float(np.log(labels[fit].mean() / (1 - labels[fit].mean()))))
    net.track = True
    sums = [np.full_like(net.table, 1e-6), np.full_like(net.filters, 1e-6), np.full_like(net.offset, 1e-6), np.full_like(net.out, 1e-6), 1e-6]
    for _ in range(-(-STEPS // -(-len(fit) // BATCH))):
        order = rng.permutation(fit)
        order = order[np.argsort([len(samples[i]) // 200 for i in order], kind="stable")]
        groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for g in rng.permutation(len(groups)):
            _step(net, [samples[i] for i in groups[g]], labels[groups[g]], sums)
    net.track = False
    sums.clear()
    check = np.flatnonzero(held) if held.any() else fit
    raw = np.concatenate([_raw(net, samples[i]) for i in check])
    net.temperature, net.bias = _calibrated(raw, labels[check], net.bias)
    net.thresholds = _thresholds(net, samples, labels, langs, check)
    return net


def _raw(net: Network, ids: np.ndarray) -> np.ndarray:
    return net.logits(ids, np.array([0, len(ids)]))


def _step(net: Network, texts: list[np.ndarray], y: np.ndarray, sums: list) -> None:
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids = np.concatenate(texts)
    if not len(ids):
        return
    h, found, e, where = net.pooled(ids, at)
    p = 1 / (1 + np.exp(-(h @ net.out + net.bias)))
    g = ((p - y) / len(y)).astype(np.float32)
    dh = np.outer(g, net.out) * (h > 0)
    word = np.full(len(e), -1, np.int64)
    word[where] = np.arange(len(ids))
    d_filters, rows, grads = np.zeros_like(net.filters), [], []
    for k, (width, col) in enumerate(zip(WIDTHS, _COLS, strict=True)):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        d, pos = dh[:, own], found[:, own]
        for j in range(width):
            here = np.minimum(pos + j, len(e) - 1)
            cols = slice(col + j * FILTERS, col + (j + 1) * FILTERS)
            d_filters[:, cols] += np.einsum("nf,nfd->df", d, e[here])
            used = (d != 0) & (word[here] >= 0) & (pos + j < len(e))
            i, f = np.nonzero(used)
            rows.append(word[here[i, f]])
            grads.append(d[i, f][:, None] * net.filters[:, cols].T[f])
    rows, grads = np.concatenate(rows), np.concatenate(grads)
    table_rows, inverse = np.unique(ids[rows], return_inverse=True)
    fixed = ~net.table[table_rows].any(axis=1)
    summed = np.zeros((len(table_rows), DIM), np.float32)
    np.add.at(summed, inverse.reshape(len(rows), -1), grads[:, None, :])
    summed[fixed] = 0
    sums[0][table_rows] += summed**2
    net.table[table_rows] -= RATE * summed / np.sqrt(sums[0][table_rows])
    for k, (name, d) in enumerate((("filters", d_filters), ("offset", dh.sum(axis=0)), ("out", h.T @ g)), 1):
        sums[k] += d**2
        getattr(net, name)[...] -= 0.5 * RATE * d / np.sqrt(sums[k])
    sums[4] += float(g.sum()) ** 2
    net.bias -= RATE * float(g.sum()) / np.sqrt(sums[4])


def _calibrated(raw: np.ndarray, y: np.ndarray, bias: float) -> tuple[float, float]:
    """Temperature and bias of least log loss and fewest wrong decisions at THRESHOLD on the rows kept back."""
    line = np.log(THRESHOLD / (1 - THRESHOLD))
    best = (np.inf, 1.0, bias)
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8):
        for shift in np.linspace(-3, 3, 25):
            z = (raw + shift) / t
            loss = float(np.mean(np.logaddexp(0, z) - y * z) + np.mean((z >= line) != (y == 1)))
            if loss < best[0] - 1e-9:
                best = (loss, t, bias + shift)
    return best[1], best[2]


def _thresholds(net: Network, samples, labels, langs, check) -> dict[str, float]:
    """Per language the threshold with the most right decisions on the rows kept back, nearest to THRESHOLD."""
    out = {}
    scores = np.concatenate([net.scores(samples[i], np.array([0, len(samples[i])])) for i in check])
    grid = sorted(np.round(np.arange(0.5, 0.91, 0.05), 2), key=lambda t: abs(t - THRESHOLD))
    for lang in {langs[i] for i in check if langs[i] is not None}:
        own = np.array([langs[i] == lang for i in check])
        if own.sum() >= 30:
            out[lang] = float(max(grid, key=lambda t: int(((scores[own] >= t) == labels[check][own]).sum())))
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Train on the labelled rows for which train_rows (of doc_id) holds."""
    bounded_batches(docs.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))
    sample = labelled_sample(rows, labels, label_col, train_rows, PER_CLASS)
    got = sample.select("doc_id", "label", "lang", F.arrow_udf(_word_ids, "binary")("text").alias("ids")).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    texts = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES)) for x in got.column("ids")]
    return train(texts, np.array(got.column("label").to_pylist(), np.int64), got.column("lang").to_pylist())


@tidy
def _word_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in batches:
        data, at = column_bytes(col)
        out = []
        for lo, hi in slices(at):
            ids, cut = hashed_words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            out += [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.array(out, pa.binary())


def score(docs: DataFrame, net: Network | None, text: Column) -> Column:
    """The score of each text; the network is a few MB whatever the corpus."""
    if net is None:
        return F.lit(0.0)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            data, at = column_bytes(col)
            parts = [shared.value.scores(*hashed_words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])) for lo, hi in slices(at)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return F.arrow_udf(run, "double")(F.coalesce(text, F.lit(""))).alias("score")


def threshold(net: Network | None, lang: Column) -> Column:
    out = F.lit(THRESHOLD)
    for name, t in sorted((net.thresholds if net else {}).items()):
        out = F.when(lang == name, F.lit(t)).otherwise(out)
    return out


def clean_documents(docs: DataFrame, labels: DataFrame, train_rows: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose score stays below their language's threshold."""
    net = fit(docs, labels, train_rows, lang_col=lang_col, text_col=text_col)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    # df's columns travel in one struct, so that none of their names can clash
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score(docs, net, F.col(text_col)).alias("score"), threshold(net, lang).alias("line"))
    return scored.filter("score < line").select("row.*")
