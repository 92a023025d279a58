"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

A text's fingerprint is a polynomial in its bytes modulo two primes. Every text becomes rows of chunks of
CHUNK bytes, which are hashed apart from each other; the hashes of a text, which are few numbers, meet in an
ordered aggregate that combines them by length-shifted arithmetic, H(xy) = H(x) * B^|y| + H(y). Rows are
grouped by fingerprint and length with map-side partial aggregates. Groups of two or more are then compared
chunk by chunk: the smallest and the largest copy of every chunk are streaming aggregates, equal for all chunks
iff the texts are equal, and no task ever holds a group. Texts that only share a fingerprint are told
apart by SHA-256. Texts to be compared are picked by a bitmap of their ids of bounded size before any shuffle.

Defined cases: null text counts as empty; empty texts are copies of each other; of rows equal in
text and doc_id exactly one stays; a null doc_id is smaller than any other; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import among, apart, bounded_batches, cut, discard, two_columns
from weftgraph.llm.textbytes import column_bytes

CHUNK = 1 << 15
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 16777619)
#: Bytes compared at once.
COMPARED = 4096
#: Fingerprints shared by unequal texts, at most a handful by chance, are broadcast up to this number, else joined by merge.
FEW = 100_000

_TABLES = []
for _p, _b in zip(PRIMES, BASES, strict=True):
    _t = [1]
    for _ in range(CHUNK):
        _t.append(_t[-1] * _b % _p)
    _TABLES.append(np.array(_t[::-1], np.int64))  # the last entry is B^0


def chunk_hash(chunk: np.ndarray, which: int) -> int:
    """Of at most CHUNK bytes: below 2^15 * 2^8 * 2^31, so the sum fits 64 bits."""
    values = chunk.astype(np.int64) + 1
    return int(np.dot(values, _TABLES[which][CHUNK + 1 - len(chunk) :])) % PRIMES[which]


def shift_of(size: int, which: int) -> int:
    """B^size: by what a hash grows when so many bytes follow."""
    return int(_TABLES[which][CHUNK - size])


def _hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["h0", "h1", "s0", "s1"]
    for col in batches:
        data, at = column_bytes(col)
        pieces = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        numbers = [[chunk_hash(x, w) for x in pieces] for w in (0, 1)] + [[shift_of(len(x), w) for x in pieces] for w in (0, 1)]
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()) for n in numbers], names)


def _chunks(text: Column, size: int) -> Column:
    """The text's bytes in pieces; an empty text is one empty piece. The text is bound once, not per piece."""
    piece = lambda data: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")), lambda i: F.substr(data, i * size + 1, F.lit(size))
    )
    return F.transform(F.array(F.encode(text, "UTF-8")), piece)[0]


def combined(parts: Column, which: int) -> Column:
    """The hash of a whole text from those of its chunks in order: below 2^62 at every step."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda h, x: (h * x[f"s{which}"] + x[f"h{which}"]) % PRIMES[which])


def fingerprints(docs: DataFrame) -> DataFrame:
    """rid, doc_id, sha, n_bytes and fp (both polynomials in 62 bits) of every row of doc_id and text."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    rows = rows.select("rid", "doc_id", "sha", "n_bytes", F.posexplode(_chunks(F.col("text"), CHUNK)).alias("at", "piece"))
    hashed = rows.select("rid", "doc_id", "sha", "n_bytes", "at", F.arrow_udf(_hashes, "h0 long, h1 long, s0 long, s1 long")("piece").alias("h"))
    # one of CHUNK bytes: numbers of a text meet, never its bytes
    pieces = cut(hashed.select("rid", "doc_id", "sha", "n_bytes", "at", "h.*"), "exact-pieces")
    one = pieces.filter(F.col("n_bytes") <= CHUNK).select("rid", "doc_id", "sha", "n_bytes", F.array(F.struct("at", "h0", "h1", "s0", "s1")).alias("parts"))
    many = pieces.filter(F.col("n_bytes") > CHUNK).groupBy("rid", "doc_id", "sha", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("at", "h0", "h1", "s0", "s1"))).alias("parts"))
    fp = F.shiftleft(combined(F.col("parts"), 0), 31).bitwiseOR(combined(F.col("parts"), 1))
    out = cut(one.unionByName(many).select("rid", "doc_id", "sha", "n_bytes", fp.alias("fp")), "exact-prints")
    discard(pieces)
    return out


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    bounded_batches(df.sparkSession)
    docs = two_columns(df, id_col, text_col)
    prints = fingerprints(docs)
    key = ["fp", "n_bytes"]
    shared = prints.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1 and n_bytes > 0").drop("n")
    # written before it is made distinct: an aggregate by the join's key would keep a large group's rows in one task
    found = cut(prints.join(apart(shared), key).select(F.col("doc_id").alias("s_id"), *key), "exact-suspects")
    suspects = found.distinct()
    pieces = (
        among(docs, suspects.select(F.col("s_id").alias("doc_id")), "doc_id")
        .join(suspects.hint("merge"), F.col("doc_id").eqNullSafe(F.col("s_id")))
        .filter(F.octet_length("text") == F.col("n_bytes"))
        .select(*key, F.posexplode(_chunks(F.col("text"), COMPARED)).alias("at", "piece"))
    )
    # a count, a smallest and a largest value: partial aggregates, whatever the size of a group
    differing = (
        pieces.groupBy(*key, "at").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).filter("lo <> hi").select(key).distinct()
    )
    differing = cut(differing, "exact-differing")
    discard(found)
    # with the few broadcast, rows stay where they are: equal texts are not dealt to one task
    split = differing.withColumn("split", F.lit(True))
    split = F.broadcast(split) if split.limit(FEW + 1).count() <= FEW else split.hint("merge")
    marked = prints.join(split, key, "left").withColumn("sub", F.when(F.col("split"), F.col("sha")).otherwise(""))
    heads = marked.groupBy(*key, "sub").agg(
        F.count("*").alias("group_size"), F.max(F.struct(F.col("doc_id"), F.col("rid"))).alias("head")
    )
    return marked.join(apart(heads), [*key, "sub"]).select(
        "doc_id", F.col("head.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("head.rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )
