"""All pairs of sparse rows with what their products pass, block by block: no table of pairs is ever shuffled or stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftgraph.storage import block_files, cut, cut_blocks, open_blocks

#: Entries and rows of one block at most on average; a task holds two blocks.
BLOCK_ENTRIES, BLOCK_ROWS = 2_000_000, 1 << 18
#: Rows of a stripe: a task multiplies stripes of its two blocks with each other.
STRIPE = 2048
#: Products that are added up at once.
CHUNK = 1 << 21
#: A product of a dense matrix costs so many times less than one of two entries found by their term.
DENSE = 400
#: Pairs that an equi-join may look at for each row of the input: it then grows with the input.
JOINED = 32

Rule = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Stripe:
    """Some rows of a block: their entries by term, and where each term begins."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, first: int, rows: int) -> None:
        order = np.argsort(term, kind="stable")
        self.row, self.term, self.weight, self.first, self.rows = row[order], term[order], weight[order], first, rows
        self.terms, self.start, self.count = np.unique(self.term, return_index=True, return_counts=True)

    def dense(self, terms: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros((self.rows, len(terms)), kind)
        at = np.searchsorted(terms, self.term)
        at[at == len(terms)] = 0
        hit = terms[at] == self.term if len(terms) else np.zeros(len(at), bool)
        out[self.row[hit], at[hit]] = self.weight[hit]
        return out


class Block:
    def __init__(self, parts: list[pa.Table]) -> None:
        table = pa.concat_tables(parts).combine_chunks()
        self.ids, self.n = table["d"].combine_chunks(), table["n"].to_numpy().astype(np.float64)
        ts, ws = table["ts"].combine_chunks(), table["ws"].combine_chunks()
        size = np.diff(ts.offsets.to_numpy()) if len(ts) else np.zeros(0, np.int64)
        self.row, self.term, self.weight = np.repeat(np.arange(len(size)), size), ts.flatten().to_numpy(), ws.flatten().to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(size)])

    def stripe(self, first: int, last: int) -> Stripe:
        last = min(last, len(self.n))
        i, j = self.ends[first], self.ends[last]
        return Stripe(self.row[i:j] - first, self.term[i:j], self.weight[i:j], first, last - first)

    def stripes(self) -> list[Stripe]:
        return [self.stripe(k, k + STRIPE) for k in range(0, len(self.n), STRIPE)]


def _expanded(x: Stripe, y: Stripe, skip: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of x, row of y and product of every two entries with one term that is not in skip, at most about CHUNK at once."""
    _, at, to = np.intersect1d(x.terms, y.terms, assume_unique=True, return_indices=True)
    if len(skip):
        stays = ~np.isin(x.terms[at], skip, assume_unique=True)
        at, to = at[stays], to[stays]
    if not len(at):
        return
    cx = x.count[at]
    # an entry of x meets the entries of y with its term
    own = np.repeat(x.start[at] - np.concatenate([[0], np.cumsum(cx)[:-1]]), cx) + np.arange(cx.sum())
    begin, n = np.repeat(y.start[to], cx), np.repeat(y.count[to], cx)
    total = np.cumsum(n)
    k = 0
    while k < len(own):
        e = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + CHUNK, "right")))
        m = n[k:e]
        left = np.repeat(own[k:e], m)
        right = np.repeat(begin[k:e] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        yield x.row[left], y.row[right], x.weight[left] * y.weight[right]
        k = e


def _met(x: Block, y: Block, same: bool, rule: Rule, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in x and y, and the sum of products, of pairs that the rule passes; within one block each pair once."""
    if not len(x.n) or not len(y.n):
        return
    whole_x, whole_y = [Stripe(b.row, b.term, b.weight, 0, len(b.n)) for b in (x, y)]
    common, at, to = np.intersect1d(whole_x.terms, whole_y.terms, assume_unique=True, return_indices=True)
    cost = whole_x.count[at].astype(np.float64) * whole_y.count[to]
    cells = float(len(x.n)) * len(y.n)
    del whole_x, whole_y
    heavy = np.sort(common[cost * DENSE > cells])
    if not len(heavy) and cost.sum() * 16 < cells:
        yield from _met_sparse(x, y, same, rule, cost.sum())
        return
    sx = x.stripes()
    sy = sx if same else y.stripes()
    dy = [s.dense(heavy, kind) for s in sy]
    for p, a in enumerate(sx):
        da = dy[p] if same else a.dense(heavy, kind)
        for q in range(p if same else 0, len(sy)):
            b = sy[q]
            out = da @ dy[q].T
            flat = out.ravel()
            for i, j, w in _expanded(a, b, heavy):
                np.add.at(flat, i * b.rows + j, w.astype(kind))
            nx, ny = x.n[a.first : a.first + a.rows], y.n[b.first : b.first + b.rows]
            i, j = np.nonzero(rule(out, nx[:, None], ny[None, :]) & (out != 0))
            if same and p == q:
                i, j = i[i < j], j[i < j]
            yield i + a.first, j + b.first, out[i, j].astype(np.float64)


def _met_sparse(x: Block, y: Block, same: bool, rule: Rule, cost: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where few pairs share a term: products of some rows of x with all of y, sorted by pair."""
    whole = y.stripe(0, len(y.n))
    step = max(1, int(len(x.n) * CHUNK / max(CHUNK, cost)))
    for first in range(0, len(x.n), step):
        a = x.stripe(first, first + step)
        key, value = [], []
        for i, j, w in _expanded(a, whole, np.zeros(0, np.int64)):
            i = i + first
            fits = i < j if same else slice(None)
            k, at = np.unique(i[fits] * len(y.n) + j[fits], return_inverse=True)
            key.append(k)
            value.append(np.bincount(at, w[fits], len(k)))
        if key:
            k, at = np.unique(np.concatenate(key), return_inverse=True)
            s = np.bincount(at, np.concatenate(value), len(k))
            i, j = k // len(y.n), k % len(y.n)
            keep = rule(s, x.n[i], y.n[j])
            yield i[keep], j[keep], s[keep]


def pair_of(k: int) -> tuple[int, int]:
    """The k-th of (0, 0), (1, 0), (1, 1), (2, 0) ..."""
    i = int(((8 * k + 1) ** 0.5 - 1) // 2)
    i += (i + 1) * (i + 2) // 2 <= k
    i -= i * (i + 1) // 2 > k
    return i, k - i * (i + 1) // 2


def tasks(spark: SparkSession, n: int) -> DataFrame:
    """The pairs of n blocks by number, a task for each of them (of very many, for several)."""
    pairs = n * (n + 1) // 2
    return spark.range(0, pairs, 1, min(pairs, 20_000))


def block_count(spark: SparkSession, rows: int, entries: int) -> int:
    """As many as the bounds of a block ask for, and enough for every core to have some pairs of blocks."""
    own = max(-(-entries // BLOCK_ENTRIES), -(-rows // BLOCK_ROWS))
    return max(1, own, min(8, rows // 512))


def joinable(freq: DataFrame, rows: int) -> bool:
    """Whether an equi-join by items that are f times in `rows` rows looks at no more than JOINED pairs for each row."""
    return (freq.agg(F.sum(F.col("f") * F.col("f"))).first()[0] or 0) <= JOINED * rows


def products(rows: DataFrame, rule: Rule, kind: type = np.float64, block_entries: int | None = None) -> DataFrame:
    """a, b, k, n_a, n_b: k is the sum of products of the weights of shared terms, of pairs a < b with k > 0 that the rule passes.

    rows: one per d and t (each pair once), with weight and n, a number of d. rule(k, n of one, n of the other) is symmetric.
    Exact. Rows are dealt to blocks that are written once, and a task multiplies two of them, stripe by stripe: terms of many
    rows as a dense matrix, others by their entries. So disk grows with the entries, a task's memory is bounded by two blocks,
    and time is quadratic where most pairs share something.
    """
    spark = rows.sparkSession
    some = rows.select("d", "t", "weight", "n").filter("d is not null and t is not null")
    # a term of one row meets nothing
    named = cut(some.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1").select("t"), "terms").select("t", F.monotonically_increasing_id().alias("term"))
    sets = some.join(named, "t").groupBy("d").agg(F.max("n").alias("n"), F.collect_list(F.struct("term", "weight")).alias("s"))
    sets = cut(sets.select("d", "n", F.col("s.term").alias("ts"), F.col("s.weight").alias("ws")), "sparse-rows")
    total = sets.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("ts")), F.lit(0)).alias("entries")).first()
    n = block_count(spark, total.rows, total.entries * BLOCK_ENTRIES // (block_entries or BLOCK_ENTRIES))
    uri = cut_blocks(sets.withColumn("block", F.pmod(F.xxhash64("d"), F.lit(n)).cast("int")), "sparse-blocks", n)
    files = block_files(spark, uri)
    d = rows.schema["d"].dataType
    schema = StructType([StructField("a", d), StructField("b", d)]).add("k", "double").add("n_a", "double").add("n_b", "double")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.column(0).to_pylist():
                i, j = pair_of(pair)
                x = Block(open_blocks(uri, files.get(i, []), pq.read_table)) if files.get(i) else None
                y = x if i == j else Block(open_blocks(uri, files.get(j, []), pq.read_table)) if files.get(j) else None
                if x is None or y is None:
                    continue
                for at, to, k in _met(x, y, i == j, rule, kind):
                    for s in range(0, len(at), 1 << 16):
                        p, q = at[s : s + (1 << 16)], to[s : s + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(p)), y.ids.take(pa.array(q)), pa.array(k[s : s + (1 << 16)]), pa.array(x.n[p]), pa.array(y.n[q])], names=["a", "b", "k", "n_a", "n_b"])

    met = tasks(spark, n).mapInArrow(multiply, schema)
    swap = F.col("a") > F.col("b")
    order = lambda u, v: F.when(swap, F.col(v)).otherwise(F.col(u))
    return met.select(order("a", "b").alias("a"), order("b", "a").alias("b"), "k", order("n_a", "n_b").alias("n_a"), order("n_b", "n_a").alias("n_b"))
