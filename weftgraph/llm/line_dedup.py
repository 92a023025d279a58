"""Line deduplication across documents, with DataFrame operations only.

Lines are reduced to two independent 64-bit hashes of their key, with document and position; no text
is shuffled to find what repeats. The hashes are range-partitioned with the document as a further range key, so
that the rows of one very common line are dealt over as many partitions as they fill, and sorted within them by
hash, document and position. A window over that sorted stream, which needs no exchange of its own, passes on
the first occurrence of a line in each document; counts and the last document per key are partial aggregates of
these, and meet in one small one. The documents' decisions are stored as run-length compressed keep
bitmaps, one per document that loses lines, and come back to the texts as such.

A key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at least `least`
code points in at least `spread` documents lose all their lines but those in the largest doc_id.

Defined cases: null or empty text is one empty line; rows with equal doc_id are one document when
documents are counted, and each its own row of the result; a null doc_id counts as one document and is
smaller than any other; an empty table gives an empty result; other columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import apart, cut, discard

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    # lower() is exact and much faster where all is ASCII
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """A row per line that may go: h1, h2, doc_id, row_print, n_lines, pos."""
    split = docs.select("doc_id", F.xxhash64("text").alias("row_print"), F.split("text", "\n", -1).alias("lines"))
    counted = split.select("doc_id", "row_print", F.size("lines").alias("n_lines"), "lines")
    lines = counted.select("doc_id", "row_print", "n_lines", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.filter(F.length("line") >= least).select("doc_id", "row_print", "n_lines", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= least).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_print", "n_lines", "pos")


def repeated_keys(lines: DataFrame, spread: int) -> DataFrame:
    """h1, h2 and keeper of the keys in at least spread documents."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, "h1", "h2", "doc_id")
    # the range keys are the window's keys: the exchange above is the only one, its sort has the position behind them
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos", "row_print")
    first = ranged.withColumn("nth", F.row_number().over(stream)).filter("nth = 1")
    return first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= spread)


def keep_bitmaps(docs: DataFrame, least: int = 40, spread: int = 5) -> DataFrame:
    """doc_id, row_print, n_dropped and keep, of documents that lose lines: the keep bitmap as runs of lines that stay."""
    lines = cut(occurrences(docs, least), "lines")
    keys = apart(repeated_keys(lines, spread).drop("n_docs")).hint("merge")
    gone = lines.join(keys, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    per = gone.groupBy("doc_id", "row_print").agg(F.array_sort(F.collect_set("pos")).alias("gone"), F.first("n_lines").alias("n_lines"))
    out = cut(per.select("doc_id", "row_print", F.size("gone").cast("long").alias("n_dropped"), _kept_runs(F.col("gone"), F.col("n_lines")).alias("keep")), "line-bitmaps")
    discard(lines)
    return out


def _kept_runs(gone: Column, n_lines: Column) -> Column:
    """The keep bitmap as runs: begin and length of the stretches of lines that stay."""
    begin = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x + 1))
    end = F.concat(gone, F.array(n_lines))
    return F.filter(F.zip_with(begin, end, lambda b, e: F.struct(b.alias("begin"), (e - b).alias("length"))), lambda r: r["length"] > 0)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, spread: int = 5) -> DataFrame:
    """df with _ld_n_lines, _ld_n_dropped, _ld_keep_runs and _ld_text (what stays) added; columns of df named _ld_… give way."""
    df = df.drop(*[c for c in df.columns if c.startswith("_ld_")])
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    maps = keep_bitmaps(docs, least, spread).select(F.col("doc_id").alias("_ld_id"), F.col("row_print").alias("_ld_print"), F.col("n_dropped").alias("_ld_gone"), F.col("keep").alias("_ld_keep"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("_ld_row", F.xxhash64(text))
    # the same plan at every size
    out = rows.join(maps.hint("merge"), F.col(id_col).eqNullSafe(F.col("_ld_id")) & (F.col("_ld_row") == F.col("_ld_print")), "left")
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    out = out.withColumn("_ld_n_lines", n.cast("long")).withColumn("_ld_n_dropped", F.coalesce("_ld_gone", F.lit(0)).cast("long"))
    whole = F.array(F.struct(F.lit(0).alias("begin"), n.alias("length")))
    out = out.withColumn("_ld_keep_runs", F.coalesce("_ld_keep", whole))
    # the one-element array makes the split a bound variable: once per row, not once per run
    stays = F.transform(F.array(lines), lambda x: F.flatten(F.transform("_ld_keep_runs", lambda r: F.slice(x, r["begin"] + 1, r["length"]))))[0]
    out = out.withColumn("_ld_text", F.when(F.col("_ld_gone").isNull(), text).otherwise(F.array_join(stays, "\n")))
    return out.drop("_ld_row", "_ld_id", "_ld_print", "_ld_gone", "_ld_keep")


def deduped_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """df's rows and columns with the lines that go taken out of the text."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = dedup_lines(rows, "key", "text", **limits)
    return out.select(*[(F.col("_ld_text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns])
