"""Questions and answers: sources, contexts, feedback, attempts, counts. Scores and texts of models are input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import strip
from weftgraph.operators.graph import best_attempt

# The feedback's sentences.
GROUNDED = "groundedness: la réponse affirme des faits absents des deux contextes — rester strictement dans les contextes fournis"
SPECIFIC = "answer_accuracy: réponse = savoir général LLM, pas spécifique aux chunks — inclure des noms/valeurs/mécanismes présents dans les contextes"
QUESTION_GROUNDED = "groundedness: the question presumes entities/facts absent from the contexts"
ANSWER_GROUNDED = "groundedness: the answer asserts facts absent from both contexts"
ANSWER_SPECIFIC = "answer_accuracy: the answer reads as general LLM knowledge, not chunk-specific"


def with_filenames(nodes: DataFrame, documents: DataFrame, edges: DataFrame, node: str = "node", filename: str = "filename") -> DataFrame:
    """nodes with a filename: their own, else that of the first document that holds them (child or contains)."""
    held = edges.filter(F.col("type").isin("child", "contains")).join(documents.select(F.col(node).alias("a"), F.col(filename).alias("_f")), "a")
    order = F.struct(*[F.col(c) for c in ("order", "a") if c in held.columns])
    first = held.filter(F.col("_f") != "").groupBy(F.col("b").alias(node)).agg(F.min_by("_f", order).alias("_f"))
    own = F.nullif(F.col(filename), F.lit("")) if filename in nodes.columns else F.lit(None).cast("string")
    return nodes.join(first, node, "left").withColumn(filename, F.coalesce(own, "_f")).drop("_f")


def source_documents(hops: Column) -> Column:
    """Of an array of structs with filename, metadata_filename, parent_doc and known_as: the first of each that isn't empty, once."""
    first = lambda h: F.coalesce(*[F.nullif(h[c], F.lit("")) for c in ("filename", "metadata_filename", "parent_doc", "known_as")])
    return F.array_distinct(F.array_compact(F.transform(hops, first)))


def hop_contexts(hops: Column, rationale: Column, most: int = 12000) -> Column:
    """Labelled contexts of an array of structs with raw, page and breadcrumb, cut before the label; the rationale leads the first."""

    def one(h: Column, k: Column) -> Column:
        raw = F.nullif(h["raw"], F.lit(""))
        body = F.when(raw.isNotNull(), F.concat_ws("\n\n", F.nullif(h["breadcrumb"], F.lit("")), raw)).otherwise(F.coalesce(h["page"], F.lit("")))
        label = F.concat(F.lit("<"), (k + 1).cast("string"), F.lit("-hop>\n"))
        lead = F.when((k == 0) & (F.coalesce(rationale, F.lit("")) != ""), F.concat(F.lit("[Semantic link: "), rationale, F.lit("]\n\n"))).otherwise("")
        return F.concat(lead, label, F.substring(body, 1, most))

    return F.transform(hops, one)


def has_context(contexts: Column) -> Column:
    """Whether any context has text behind its first line."""
    rest = lambda c: strip(F.regexp_replace(strip(c), r"\A[^\n]*\n?", ""))
    return F.exists(contexts, lambda c: rest(c) != "")


def seeded_pairs(rows: DataFrame, a: str, b: str, order: str, done: DataFrame) -> DataFrame:
    """The first row of every unordered pair that no row of done has."""
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(order)
    first = rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
    seen = done.select(F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y"))
    return first.join(seen, (F.least(a, b) == F.col("_x")) & (F.greatest(a, b) == F.col("_y")), "left_anti")


def evaluated(enabled: bool, failed: Column, scores: dict[str, Column]) -> dict[str, Column]:
    """The judge's columns: without a judge, or where it failed, an attempt passes; without one all scores are null."""
    if not enabled:
        return {k: (F.lit(True) if k == "passed" else F.lit(None).cast("double") if k.endswith("_score") else v) for k, v in scores.items()}
    return {k: (F.coalesce(F.when(failed, True), v) if k == "passed" else v) for k, v in scores.items()}


def feedback(ground: Column, accuracy: Column, two_hop: Column, needs_verdict: Column, uses_verdict: Column, threshold: float = 0.8) -> dict[str, Column]:
    """feedback, question_feedback and answer_feedback: what failed, parts apart by ' | '. Verdicts are null where nothing is said."""
    said = lambda c: F.nullif(c, F.lit(""))
    low = lambda c, text: F.when(c < threshold, F.lit(text))
    hop = F.concat_ws(" | ", F.concat(F.lit("2hop question: "), said(needs_verdict)), F.concat(F.lit("2hop answer: "), said(uses_verdict)))
    none = F.when((two_hop < threshold) & (hop == ""), F.concat(F.lit("two_hop: score "), F.format_string("%.2f", two_hop), F.lit(" below threshold")))
    join = lambda *parts: F.concat_ws(" | ", *parts)
    return {
        "feedback": join(said(hop), low(ground, GROUNDED), low(accuracy, SPECIFIC), none),
        "question_feedback": join(F.concat(F.lit("question_needs_both: "), said(needs_verdict)), low(ground, QUESTION_GROUNDED)),
        "answer_feedback": join(low(ground, ANSWER_GROUNDED), low(accuracy, ANSWER_SPECIFIC), F.concat(F.lit("answer_uses_both: "), said(uses_verdict))),
    }


def last_attempts(rows: DataFrame, question: str, attempt: str, passed: str, max_retry: int = 2) -> DataFrame:
    """The attempt that counts of every question, with attempts (made until then) and validator_rejected (none passed)."""
    tried = rows.filter(F.col(attempt) <= max_retry + 1)
    best = best_attempt(tried, question, attempt, passed)
    rejected = F.col(passed).isNotNull() & ~F.coalesce(F.col(passed), F.lit(True))
    return best.withColumn("attempts", F.col(attempt)).withColumn("validator_rejected", rejected)


def type_distribution(questions: DataFrame, kind: str, passed: str) -> DataFrame:
    """kind, n, n_passed and pass_rate (of those evaluated), most frequent first."""
    out = questions.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("n_passed"), F.count(passed).alias("n_evaluated"))
    return out.withColumn("pass_rate", F.col("n_passed") / F.nullif(F.col("n_evaluated"), F.lit(0))).orderBy(F.desc("n"), kind)


def page(rows: DataFrame, order: list[str], number: int, size: int = 10) -> DataFrame:
    """Page `number` (from 1) of rows in order."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def overall(scores: list[Column]) -> tuple[Column, Column]:
    """The least and the mean of the scores, null if one is."""
    known = F.array(*scores)
    whole = ~F.exists(known, lambda x: x.isNull())
    return F.when(whole, F.array_min(known)), F.when(whole, sum(scores[1:], scores[0]) / len(scores))


def count_above(rows: DataFrame, score: Column, threshold: float) -> DataFrame:
    return rows.agg(F.count_if(score >= threshold).alias("n_above"), F.count("*").alias("n"))


def compare_runs(questions: DataFrame, run: str, passed: str, scores: list[str]) -> DataFrame:
    """run, n, pass_rate and the mean of each score: runs side by side."""
    means = [F.avg(s).alias(f"mean_{s}") for s in scores]
    return questions.groupBy(run).agg(F.count("*").alias("n"), (F.count_if(F.col(passed)) / F.count("*")).alias("pass_rate"), *means)
