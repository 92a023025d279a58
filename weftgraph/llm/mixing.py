"""Mixing sources to target weights by hash-threshold histograms.

Every source's target is its share of 1.5 times all words, by weight, at most twice its own words;
what a full source leaves is shared again by weight (water filling, closed form over the sources).
A source takes whole passes over its documents and, for the rest of its target, the documents whose
hash is below a threshold. The threshold is found without sorting or collecting documents: words
are summed by source and the top 12 bits of the hash, a running sum over those at most 4096
buckets finds the boundary bucket, and only that one is refined, by 16 and by 32 further bits. Below
the last boundary is at most one document (more only with equal ids); it takes a part, so that
the target is met to a word. All of it works on partial aggregates, so a source with a third of
all rows costs no more than others.

The targets are windows over one row per source in one task: sources are collections, some thousands at most; where they
are as many as hosts, group them before.

Defined cases: null text has size 0; a null source is a source, sorted last; a null doc_id hashes as
the text "null"; rows with equal ids share what falls to them, rounded down; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, discard

#: Weights by the rank of a source, repeating; the budget as a multiple of all words; most passes.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each histogram looks at: 60 together.
LEVELS = (12, 16, 32)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """A row per source: source, source_size, target. One row per source goes into the windows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int")))
    whole = Window.partitionBy(F.lit(0))
    # sources fill up in the order of most * size / weight
    order = whole.orderBy(F.col("full_at"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("full_at", most * F.col("source_size") / F.col("weight")).withColumn("all", F.sum("source_size").over(whole) * F.lit(budget))
    per = per.withColumn("filled", F.coalesce(F.sum(most * F.col("source_size")).over(order), F.lit(0)))
    per = per.withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    # the level if all sources before this one are full and the rest share
    per = per.withColumn("level", (F.col("all") - F.col("filled")) / F.col("open_weight"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(whole)["level"]
    per = per.withColumn("at", level)
    return per.select(
        "source", "source_size", F.least(F.col("weight") * F.coalesce("at", "full_at"), F.lit(most) * F.col("source_size")).cast("double").alias("target")
    )


def document_hash(doc_id: Column) -> Column:
    """60 bits of MD5: the same on any engine."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _boundaries(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source with a rest: the 60-bit hash where its running sum passes the rest, and what is left there."""
    bound = goals.select(F.col("source").alias("b_source"), F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"), F.lit(0).cast("long").alias("inside"))
    shift = 60
    for bits in LEVELS:
        upper, shift = shift, shift - bits
        inside = sizes.join(bound, F.col("source").eqNullSafe(F.col("b_source"))).filter(F.shiftright("hash", upper) == F.col("prefix"))
        hist = inside.groupBy("b_source", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("b_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        hit = hist.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
        bound = hit.select("b_source", F.col("bucket").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), F.col("words").alias("inside"))
    return bound


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False, **shares) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken (words; repeats counted).

    With keep, every row of df comes back with its own columns in the struct `row`.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep else []
    measured = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), document_hash(F.col(id_col)).alias("hash"), *row)
    sizes = cut(measured.drop("row"), "mix-sizes")
    goals = targets(sizes, **shares).withColumn("passes", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    goals = cut(goals.withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")), "mix-goals")
    bound = _boundaries(sizes, goals)
    plan = cut(goals.join(bound, F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source").withColumnRenamed("source", "p_source"), "mix-plan")
    discard(goals)
    rows = measured if keep else sizes
    part = F.floor(F.col("left").cast("decimal(38,0)") * F.col("size") / F.greatest(F.col("inside"), F.lit(1))).cast("long")
    extra = F.when(F.col("hash") < F.col("prefix"), F.col("size")).when(F.col("hash") == F.col("prefix"), part).otherwise(0)
    # no boundary: the rest is zero
    extra = F.coalesce(extra, F.lit(0))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"), *(["row"] if keep else []))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The mix itself: every document as often as it is taken, with df's columns.

    Documents are whole: the boundary document, of which a source takes a part, is rounded to a
    whole number of copies. Documents without words are not part of any mix.
    """
    mixed = mix_sources(df, id_col, text_col, source_col, keep=True, **shares)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")).otherwise(0)
    return mixed.filter(copies > 0).select(F.explode(F.array_repeat("row", copies)).alias("row")).select("row.*")
