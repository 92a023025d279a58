"""A corpus pipeline of five of the training-data operators, each stage a table that the next one reads."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, line_dedup, minhash, mixing
from weftgraph.llm import toxicity as toxic
from weftgraph.llm.common import is_held_out, shared_dir, table
from weftgraph.llm.queries import TOKENIZER


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those whose score reaches their language's threshold.

    A null or empty text has the score of no words and stays unless most labelled texts are toxic; a null or unknown language
    has the general threshold; without labels of both classes all stay; an empty table stays empty; the columns are those of docs.
    """
    return toxic.clean_documents(docs, table(spark, sf_dir, "labels"), ~is_held_out(F.col("doc_id"), 3, 1))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in five documents or more go from all but the one with the largest doc_id; n_chars follows.

    Null texts become empty ones; texts whose lines all go stay as empty documents; rows with equal doc_id are one document in
    the count; an empty table stays empty; the columns are those of docs.
    """
    out = line_dedup.deduped_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest doc_id stays.

    Texts without words are alone and stay; rows with equal doc_id stay or go together; rows with a null doc_id stay; an empty
    table stays empty; the columns are those of docs.
    """
    return minhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most twice; a source's target is met to within one document.

    Documents without words are part of no mix; a null source is a source of its own, the last; a null doc_id has a hash like any
    other; an empty table stays empty; the columns are those of docs.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids and the SHA-256 of what they decode to, a row per row of docs.

    Null and empty texts have no tokens; repeated rows each have their own; an empty table stays empty.
    """
    coder = bpe.codec(public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return docs.select("doc_id", "source", bpe.tokenized(spark, F.col("text"), coder).alias("t")).select("doc_id", "source", "t.*")


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("minhash", near_duplicates), ("mixing", mixture), ("byte_bpe", tokens)]

#: Trained scores, sketches and BPE are not SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
