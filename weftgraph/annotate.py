"""The boundary to models: requests go out as rows, answers come back as rows, joined by a hash of the request.

What a model would say is never computed elsewhere. A missing answer is null; each operator says what null means to it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import tokens

# What an error says that is worth another try.
TRANSIENT = (
    "invalid model name", "connection error", "timeout", "timed out", "temporarily unavailable", "service unavailable", "bad gateway", "gateway timeout",
    "rate limit", "too many requests", "overloaded", "internal server error", " 429", " 500", " 502", " 503", " 504",
)


def request_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def is_transient(error: Exception) -> bool:
    return any(mark in str(error).lower() for mark in TRANSIENT)


def with_retries(call: Callable, tries: int = 6, first_wait: float = 3.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after a transient error, waiting first_wait and then twice as long each time."""
    for k in range(tries):
        try:
            return call()
        except Exception as error:
            if k + 1 == tries or not is_transient(error):
                raise
            sleep(first_wait * 2**k)


class Recorded:
    """Answers from a table with the columns request and those of the answer; the first by their order if there are several."""

    def __init__(self, answers: DataFrame):
        self.answers = answers.dropDuplicates(["request"])

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.answers, "request", "left")


class RuleBased:
    """Answers as column expressions over the requests."""

    def __init__(self, **answer: Column):
        self.answer = answer

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.select("*", *[c.alias(k) for k, c in self.answer.items()])


class Called:
    """Answers from a user's function, called in the tasks with batches of requests as a list of dicts.

    It returns a list of dicts, one per request. A batch that fails in the end has null answers.
    """

    def __init__(self, answer_schema: str, call: Callable[[list[dict]], list[dict]], batch: int = 5, tries: int = 6, first_wait: float = 3.0):
        self.answer_schema, self.call, self.batch, self.tries, self.first_wait = answer_schema, call, batch, tries, first_wait

    def __call__(self, requests: DataFrame) -> DataFrame:
        names = [x.strip().split()[0] for x in self.answer_schema.split(",")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", " + self.answer_schema
        call, batch, tries, wait = self.call, self.batch, self.tries, self.first_wait

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                answers = []
                for k in range(0, len(frame), batch):
                    part = frame.iloc[k : k + batch].to_dict("records")
                    try:
                        got = with_retries(lambda part=part: call(part), tries, wait)
                    except Exception:
                        got = [{}] * len(part)
                    answers += [[a.get(n) for n in names] for a in got]
                yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(answers, columns=names, dtype=object)], axis=1)

        return requests.mapInPandas(run, schema)


def annotate(rows: DataFrame, inputs: list[str], annotator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the annotator's columns; equal requests are asked once."""
    keyed = rows.withColumn("request", request_hash(*[F.col(c) for c in inputs]))
    asked = annotator(keyed.select("request", *inputs).dropDuplicates(["request"])).drop(*inputs)
    return keyed.join(asked, "request", "left").drop("request")


def unanswered(rows: DataFrame, answers: str) -> DataFrame:
    """Rows that still have to be asked: those without answers (null or an empty array) from a cache."""
    return rows.filter(F.col(answers).isNull() | (F.size(answers) == 0))


def rule_keyphrases(chunks: DataFrame, node: str, text: str, most: int = 10) -> DataFrame:
    """node and keyphrases: a chunk's words of four letters or more with the highest tf-idf, ties by the word."""
    words = chunks.select(node, F.explode(F.filter(tokens(F.lower(text)), lambda w: w.rlike(r"^\p{L}{4,}$"))).alias("w"))
    tf = words.groupBy(node, "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    n = chunks.select(node).distinct().agg(F.count("*").alias("n"))  # one row
    scored = tf.join(df, "w").join(F.broadcast(n)).withColumn("s", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy(node).orderBy(F.desc("s"), "w"))).filter(F.col("place") <= most)
    return best.groupBy(node).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]).alias("keyphrases"))


def with_keyphrases(chunks: DataFrame, node: str, text: str, cached: str, most: int = 10) -> DataFrame:
    """chunks with keyphrases: the cached ones where there are any, else the rule-based ones (empty where a chunk has no word)."""
    found = rule_keyphrases(unanswered(chunks, cached), node, text, most).withColumnRenamed("keyphrases", "_found")
    own = F.coalesce(F.when(F.size(cached) > 0, F.col(cached)), F.col("_found"), F.array().cast("array<string>"))
    return chunks.join(found, node, "left").withColumn("keyphrases", F.slice(own, 1, most)).drop("_found")
