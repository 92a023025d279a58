"""Datasets: JSON with what made it, BEIR, CSV. Everything that grows is written by Spark; a header is one small row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = (
    "question_id", "question", "answer", "context_1", "context_2", "chunk_id_1", "chunk_id_2", "doc_id", "question_type", "persona",
    "qa_groundedness", "qa_accuracy", "qa_two_hop", "qa_overall", "two_hop_judge_score",
)


def dataset_header(questions: DataFrame, version: str = "v2.0", **fields: str) -> DataFrame:
    """One row: version, num_questions, created_at and the given fields."""
    own = [F.lit(v).alias(k) for k, v in fields.items() if v is not None]
    return questions.agg(F.count("*").alias("num_questions")).select(F.lit(version).alias("version"), *own, "num_questions", F.current_timestamp().alias("created_at"))


def write_dataset(questions: DataFrame, folder: str, scores: DataFrame | None = None, **fields: str) -> None:
    """header, questions and, if given, qa_scores as JSON lines. Fields: config, domain, tools_used, filters_used."""
    dataset_header(questions, **fields).write.mode("overwrite").json(f"{folder}/header")
    questions.write.mode("overwrite").json(f"{folder}/questions")
    if scores is not None:
        scores.write.mode("overwrite").json(f"{folder}/qa_scores")


def write_job_dataset(questions: DataFrame, folder: str, session_id: str, job_id: str) -> None:
    write_dataset(questions, f"{folder}/{session_id}/{job_id}", session_id=session_id, job_id=job_id)


def beir_corpus(chunks: DataFrame) -> DataFrame:
    """_id, title, text, metadata{source, chunk_index} of chunks: chunk_id, section_title, content, filename, chunk_index."""
    return chunks.select(F.col("chunk_id").cast("string").alias("_id"), F.coalesce("section_title", F.lit("")).alias("title"), F.col("content").alias("text"), F.struct(F.col("filename").alias("source"), "chunk_index").alias("metadata"))


def beir_queries(questions: DataFrame) -> DataFrame:
    """_id, text, metadata{type, persona}."""
    return questions.select(F.col("question_id").cast("string").alias("_id"), F.col("question").alias("text"), F.struct(F.col("question_type").alias("type"), "persona").alias("metadata"))


def beir_qrels(questions: DataFrame) -> DataFrame:
    """query_id, corpus_id, score 1 of every chunk that a question rests on, each once."""
    rows = questions.select(F.col("question_id").cast("string").alias("query_id"), F.explode("node_ids").alias("corpus_id"))
    return rows.select("query_id", F.col("corpus_id").cast("string").alias("corpus_id"), F.lit(1).alias("score")).distinct()


def dataset_csv(questions: DataFrame) -> DataFrame:
    """The flat columns of a dataset: contexts and chunks of the first two hops, the scores, their mean as qa_overall."""
    hop = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(""))
    ids = lambda k: F.get("node_ids", F.lit(k)).cast("string")
    scores = [F.col(f"qa_eval.{c}") for c in ("groundedness_score", "answer_accuracy_score", "two_hop_score")]
    mean = (scores[0] + scores[1] + scores[2]) / 3
    values = [
        F.col("question_id").cast("string"), F.col("question"), F.col("reference"), hop("reference_contexts", 0), hop("reference_contexts", 1), ids(0), ids(1),
        F.get("source_documents", F.lit(0)), F.col("question_type"), F.col("persona"), *scores, mean, scores[2],
    ]
    return questions.select(*[v.alias(k) for k, v in zip(CSV_COLUMNS, values, strict=True)])


def write_beir(chunks: DataFrame, questions: DataFrame, folder: str) -> None:
    beir_corpus(chunks).write.mode("overwrite").json(f"{folder}/corpus")
    beir_queries(questions).write.mode("overwrite").json(f"{folder}/queries")
    beir_qrels(questions).write.mode("overwrite").json(f"{folder}/qrels")


def write_csv(questions: DataFrame, folder: str) -> None:
    dataset_csv(questions).write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/dataset")
