"""Byte-level BPE encoding and decoding by a rank file, two tiers.

Pre-tokens are found by code-point classes with numpy and grouped by 64-bit hash. A minimal perfect
hash over the vocabulary (levels of collision-free bits with ranks, after Limasset et al. 2017)
resolves those that are vocabulary entries as a whole. The others are merged with a heap of
(rank, position) over bytes in a linked list. Decoding maps the ids back to bytes; if a decoded text
differs from its source (two pre-tokens with one hash), that text is encoded again token by token,
so the result never depends on a hash.

Defined cases: null or empty text has no tokens; texts that hold an apostrophe, which can begin a
contraction, are split by the regular expression itself; an empty table gives an empty result;
other columns are not looked at. A worker remembers a bounded number of merged pre-tokens.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, tidy
from weftgraph.llm.textbytes import AS_IS, Spans, column_bytes, mix, slices

#: Merged pre-tokens that a worker remembers, in two halves of so many (about 250 bytes each).
MEMO = 60_000
_LETTER, _NUMBER, _WHITE, _OTHER = 1, 2, 3, 4


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id of a .tiktoken file, whose ids run from 0."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash: key hashes to 0..n-1, by levels of bits that only one key sets."""

    def __init__(self, keys: np.ndarray, load: float = 1.5):
        self.bits, self.ranks, base, left, level = [], [], 0, np.unique(keys), 0
        if len(left) != len(keys):
            raise ValueError("keys must differ")
        while len(left):
            size = max(64, int(load * len(left)))
            at = self._place(left, level, size)
            bit = np.bincount(at, minlength=size) == 1
            self.bits.append(bit)
            self.ranks.append(base + np.cumsum(bit) - 1)
            base += int(bit.sum())
            left, level = left[~bit[at]], level + 1

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0xA0761D6478BD642F * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots; a key that isn't of the set gets some slot or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bit, rank) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = self._place(keys[todo], level, len(bit))
            hit = bit[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def merge(word: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left: heap over a linked list.

    pairs: the rank of each two bytes, -1 where they are no token. A heap entry is rank, begin and
    end of the merged piece in one integer.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    bits = n.bit_length()
    low = (1 << bits) - 1
    heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := pairs[word[i] << 8 | word[i + 1]]) >= 0]
    heapify(heap)
    end = list(range(1, n + 1))  # of the piece that begins here, which is where the next begins; 0: merged away
    before = list(range(-1, n - 1))
    get = ranks.get
    while heap:
        x = heappop(heap)
        stop, i = x & low, x >> bits & low
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has grown or gone
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heappush(heap, (r << bits | i) << bits | end[stop])
        if (h := before[i]) >= 0 and (r := get(word[h:stop])) is not None:
            heappush(heap, (r << bits | h) << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, as the pattern's engine sees it."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            lo, hi = (x if x < 0xD800 else x + 0x800 for x in (a, b - 1))
            out[lo : hi + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return out


def token_starts(points: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of a text without apostrophes begin (code points)."""
    n = len(points)
    kind = _classes()[points]
    fresh = np.ones(n, bool)
    fresh[1:] = kind[1:] != kind[:-1]
    white = kind == _WHITE
    # the last of a run of white space that something follows stands apart or joins what follows
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:]
    fresh |= last
    # what follows a plain space begins with it
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (points[:-1] == 32)
    return np.flatnonzero(fresh & ~joined)


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern

    def prepare(self) -> None:
        if hasattr(self, "ranks"):
            return
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.find = regex.compile(self.pattern).findall
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        keys = Spans(self.flat, AS_IS).of(self.begin[:-1], self.begin[1:])
        self.mph = PerfectHash(keys)
        slot = self.mph(keys)
        self.slot_id, self.slot_key = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint64)
        self.slot_id[slot], self.slot_key[slot] = np.arange(len(keys)), keys
        digits = [str(i).encode() + b"," for i in range(len(self.tokens))]
        self.digit_sizes = np.array([len(x) for x in digits], np.int64)
        self.digit_begin = np.concatenate([[0], np.cumsum(self.digit_sizes)])
        self.digit_flat = np.frombuffer(b"".join(digits), np.uint8)
        self.pairs = [self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.memo: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern}

    def word(self, token: bytes) -> list[int]:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo  # what is still in use comes back from the older half
            got = self.memo[token] = self.older.get(token) or merge(token, self.ranks, self.pairs)
        return got

    def plain(self, text: str) -> np.ndarray:
        """The ids of one text, token by token."""
        return np.array([i for t in self.find(text) for i in self.word(t.encode())], np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.flat, self.begin[ids], self.sizes[ids])

    def decimal(self, ids: np.ndarray) -> np.ndarray:
        """The ids in decimal, each with a comma behind it."""
        return _gather(self.digit_flat, self.digit_begin[ids], self.digit_sizes[ids])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, and where each row's begin."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        points = np.frombuffer(str(data.data, "utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        rows = np.searchsorted(lead, at)
        starts = np.concatenate([token_starts(points[a:b]) + a for a, b in zip(rows[:-1], rows[1:], strict=True) if b > a])
        begin = lead[starts]
        end = np.append(begin[1:], len(data))
        keys, where = np.unique(Spans(data, AS_IS).of(begin, end), return_inverse=True)
        one = np.empty(len(keys), np.int64)
        one[where] = np.arange(len(begin))
        slot = self.mph(keys)
        whole = (slot >= 0) & (self.slot_key[slot] == keys)
        pieces = [None] * len(keys)
        raw = data.tobytes()
        for k in np.flatnonzero(~whole).tolist():
            pieces[k] = self.word(raw[begin[one[k]] : end[one[k]]])
        counts = np.ones(len(keys), np.int64)
        missed = np.flatnonzero(~whole)
        counts[missed] = [len(pieces[k]) for k in missed.tolist()]
        flat = np.empty(int(counts.sum()), np.int64)
        first = np.cumsum(counts) - counts
        flat[first[whole]] = self.slot_id[slot[whole]]
        if len(missed):
            flat[_ranges(first[missed], counts[missed])] = [i for k in missed.tolist() for i in pieces[k]]
        n = counts[where]
        ids = _gather(flat, first[where], n)
        token_row = np.searchsorted(begin, at)
        return ids, np.concatenate([[0], np.cumsum(n)])[token_row]

    def rows(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per row its ids, their decimal form and the decoded bytes."""
        if self.pattern != public_tokenizers.PATTERN:  # token_starts knows that one only
            for k in range(len(at) - 1):
                own = self.plain(data[at[k] : at[k + 1]].tobytes().decode())
                yield own, self.decimal(own)[:-1], self.decode(own)
            return
        ids, cut = self.encode(data, at)
        decoded, digits = self.decode(ids), self.decimal(ids)
        size = np.concatenate([[0], np.cumsum(self.sizes[ids])])[cut]
        width = np.concatenate([[0], np.cumsum(self.digit_sizes[ids])])[cut]
        for k in range(len(at) - 1):
            text = data[at[k] : at[k + 1]]
            own, back, form = ids[cut[k] : cut[k + 1]], decoded[size[k] : size[k + 1]], digits[width[k] : width[k + 1]]
            if (text == 39).any() or not np.array_equal(text, back):
                own = self.plain(text.tobytes().decode())
                back, form = self.decode(own), self.decimal(own)
            yield own, form[:-1], back


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(counts)
    out = np.ones(int(total[-1]) if len(total) else 0, np.int64)
    filled = counts > 0
    first, counts = first[filled], counts[filled]
    if not len(first):
        return out
    out[0] = first[0]
    out[np.cumsum(counts)[:-1]] = first[1:] - (first[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def _gather(flat: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return flat[_ranges(first, counts)]


def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def _udf(spark: SparkSession, coder: Codec, kind: str, fields):
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(coder)  # the rank file: under 2 MB, whatever the corpus

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        own.prepare()
        for col in batches:
            data, at = column_bytes(col)
            rows = [x for lo, hi in slices(at) for x in fields(own, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])]
            yield pa.array(rows, _ARROW[kind])

    return F.arrow_udf(run, kind).asNondeterministic()


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_FULL = "n_tokens long, token_ids array<int>, decoded_sha256 string"
_ARROW = {
    _DIGEST: pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
    "array<int>": pa.list_(pa.int32()),
    _FULL: pa.struct([("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())]),
}


def _digests(coder: Codec, data: np.ndarray, at: np.ndarray) -> list[dict]:
    return [
        {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(form).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()}
        for ids, form, back in coder.rows(data, at)
    ]


def _id_lists(coder: Codec, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [ids.astype(np.int32) for ids, _, _ in coder.rows(data, at)]


def _full(coder: Codec, data: np.ndarray, at: np.ndarray) -> list[dict]:
    return [{"n_tokens": len(ids), "token_ids": ids.astype(np.int32), "decoded_sha256": hashlib.sha256(back).hexdigest()} for ids, _, back in coder.rows(data, at)]


def tokenized(spark: SparkSession, text: Column, coder: Codec) -> Column:
    """n_tokens, token_ids and decoded_sha256 of each text."""
    return _udf(spark, coder, _FULL, _full)(F.coalesce(text, F.lit("")))


def token_digests(spark: SparkSession, text: Column, coder: Codec) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256 of each text."""
    return _udf(spark, coder, _DIGEST, _digests)(F.coalesce(text, F.lit("")))


def token_ids(spark: SparkSession, text: Column, coder: Codec) -> Column:
    """The ids of each text."""
    return _udf(spark, coder, "array<int>", _id_lists)(F.coalesce(text, F.lit("")))


def token_text(spark: SparkSession, ids: Column, coder: Codec) -> Column:
    """The bytes that each list of ids stands for."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(coder)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        own.prepare()
        for col in batches:
            yield pa.array([own.decode(np.asarray(x or [], np.int64)).tobytes() for x in col.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(ids)
