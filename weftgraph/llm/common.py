"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.storage import cut, discard, shared_dir  # noqa: F401  the operators' own import them from here

#: Bytes and rows of an Arrow batch sent to a Python worker, so that a worker's memory stays bounded.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048
#: The bitmap by which rows are picked: 32 MB at most.
BITMAP_BITS = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as rows: one batch of long texts must not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """run, an Arrow UDF over an iterator of batches, that gives freed memory back to the system when its task ends.

    Workers are used again by later tasks and stages, and their allocators would keep the most that any task took.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def apart(df: DataFrame) -> DataFrame:
    """An aggregate, dealt anew: as the result of an exchange of its own it lets adaptive execution split the
    other side of a join where one key is very common, which it can't above an aggregate by that key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only doc_id and text (null text: empty), whatever other columns there are."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def marked(rows: DataFrame, ids: DataFrame, col: str, mark: str = "_maybe") -> DataFrame:
    """rows with mark: whether col is one of ids. False is certain, true is not: by a bitmap of at most BITMAP_BITS.

    The bitmap is a table of 4 KB pieces, at most BITMAP_BITS / 8 bytes together, which is the proven bound of its broadcast.
    """
    bits = 1 << 16
    while bits < min(BITMAP_BITS, 16 * ids.count()):
        bits *= 2
    slot = F.pmod(F.xxhash64(col), F.lit(bits)) + 1
    pieces = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    placed = rows.withColumn("_slot", slot).withColumn("_at", F.bitmap_bit_position("_slot"))
    both = placed.join(F.broadcast(pieces), F.bitmap_bucket_number("_slot") == F.col("_piece"), "left")
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod("_at", F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return both.withColumn(mark, F.coalesce(bit, F.lit(False))).drop("_slot", "_at", "_piece", "_bits")


def among(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """rows whose col is one of ids, and a few others."""
    return marked(rows, ids, col).filter("_maybe").drop("_maybe")


def is_held_out(doc_id, modulus: int, remainder: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


#: Longer labelled texts (UTF-8 bytes) are not taken into a training sample.
LONGEST = 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, per_class: dict[int, int], label_id: str = "doc_id") -> DataFrame:
    """doc_id, label and the other columns of docs, of at most per_class[y] labelled ids of each class, the smallest by hash.

    train: a predicate on doc_id. The chosen ids number at most sum(per_class), so they are broadcast. Of rows with one id
    and label one is taken, and none whose text is longer than LONGEST: sum(per_class) * LONGEST bytes is a proven bound.
    """
    rows = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & train)
    chosen = None
    for y, n in per_class.items():
        some = rows.filter(F.col("label") == y).distinct().orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.filter(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), "text", *others)).alias("r"))
    return one.select("doc_id", "label", *[F.col(f"r.{c}").alias(c) for c in ("text", *others)])
