"""Themes, question types and budgets of scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftgraph.functions.text import jaccard, strip, tokens


def themes(overlapped: Column, shared_theme: Column, terms_a: Column, terms_b: Column) -> Column:
    """Overlapped items, else the shared theme, else up to 10 shared terms, else the first 5 terms of both; null if none."""
    filled = lambda x: F.when(F.size(x) > 0, x)
    none = F.array().cast("array<string>")
    a, b = F.coalesce(terms_a, none), F.coalesce(terms_b, none)
    named = F.when(F.trim(shared_theme) != "", F.array(shared_theme))
    return F.coalesce(filled(overlapped), named, filled(F.slice(F.array_intersect(a, b), 1, 10)), filled(F.slice(F.array_union(F.slice(a, 1, 5), F.slice(b, 1, 5)), 1, 10)))


def qualified(types: Column, taxonomy: list[str]) -> Column:
    """The types that the taxonomy has; all of it if there are none."""
    known = F.array(*[F.lit(t) for t in taxonomy])
    both = F.array_intersect(types, known)
    return F.when(F.size(both) > 0, both).otherwise(known)


def assign_types(rows: DataFrame, group: str, order: str, types: str, budget: dict[str, float]) -> DataFrame:
    """rows with question_type: of the compatible types the one furthest behind its target share, one row after another.

    Every choice depends on all earlier ones of its group, so a group is one task's; groups are read one behind the other from
    sorted partitions, and only the counts of one group are kept. Of equal lags the type named first in the budget wins;
    without a known compatible type the first compatible one is taken, else 'integration'.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = dict.fromkeys(budget, 0), 0
        for batch in batches:
            out = []
            for nth, compatible in zip(batch.column("_nth").to_pylist(), batch.column(types).to_pylist(), strict=True):
                if nth == 1:
                    counts, total = dict.fromkeys(budget, 0), 0
                compatible = compatible or []
                known = [t for t in budget if t in compatible]
                n = max(1, total)
                pick = max(known, key=lambda t: budget[t] - counts[t] / n) if known else (compatible or ["integration"])[0]  # noqa: B023
                if pick in counts:
                    counts[pick] += 1
                    total += 1
                out.append(pick)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out, pa.string())], names=[*columns, "question_type"])

    columns = rows.columns
    schema = StructType([*rows.schema.fields, StructField("question_type", StringType())])
    # the window deals groups to tasks, sorts them and marks where each begins
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).asc_nulls_last())))
    return numbered.mapInArrow(assign, schema)


def fit_budget(budget: dict[str, float], allowed: list[str] | None = None) -> dict[str, float]:
    """Only allowed types (all, if none is allowed), shares summing to 1 at 6 places, the first takes the residue."""
    kept = {k: v for k, v in budget.items() if allowed is None or k in allowed} or dict(budget)
    total = sum(kept.values())
    if total <= 0:
        raise ValueError("the budget has no positive share")
    out = {k: round(v / total, 6) for k, v in kept.items()}
    first = next(iter(out))
    out[first] = round(out[first] + 1 - sum(out.values()), 6)
    return out


# ---- triplets ----


def find_triplets(edges: DataFrame, chunks: DataFrame, node: str, columns: list[str], kinds: tuple[str, ...], kind: str = "type") -> DataFrame:
    """Edges (a, b) of the given types with the columns of both chunks, named with _a and _b; ends that are no chunks drop an edge."""
    one = lambda s: chunks.select(F.col(node).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return edges.filter(F.col(kind).isin(*kinds)).join(one("a"), "a").join(one("b"), "b")


def or_unfiltered(filtered: DataFrame, rows: DataFrame) -> DataFrame:
    """filtered, or all rows if nothing is left of them."""
    return rows if filtered.isEmpty() else filtered


def of_different_sections(triplets: DataFrame, subdivision: str = "is_subdivision", breadcrumb: str = "breadcrumb") -> DataFrame:
    """Without pairs of pieces of one long section: both subdivisions with one breadcrumb. If none is left, all."""
    same = F.col(f"{subdivision}_a") & F.col(f"{subdivision}_b") & F.col(f"{breadcrumb}_a").eqNullSafe(F.col(f"{breadcrumb}_b"))
    return or_unfiltered(triplets.filter(~F.coalesce(same, F.lit(False))), triplets)


def structural_triplets(triplets: DataFrame, edges: DataFrame, chunks: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """triplets, or those of edges `child` and `next` if there are none."""
    return find_triplets(edges, chunks, node, columns, ("child", "next")) if triplets.isEmpty() else triplets


def not_rejected(verdict: Column) -> Column:
    """Only false rejects; null is no verdict."""
    return F.coalesce(verdict, F.lit(True))


def similar_enough_apart(triplets: DataFrame, text: str = "text", most: float = 0.20) -> DataFrame:
    """Without pairs of empty texts, and those whose texts share more than `most` of their tokens (texts with breadcrumbs)."""
    words = {s: F.array_distinct(tokens(F.lower(F.coalesce(F.col(f"{text}_{s}"), F.lit(""))))) for s in "ab"}
    both = triplets.filter("a is not null and b is not null").withColumn("_wa", words["a"]).withColumn("_wb", words["b"])
    return both.filter((F.size("_wa") > 0) & (F.size("_wb") > 0) & (jaccard(F.col("_wa"), F.col("_wb")) <= most)).drop("_wa", "_wb")


# ---- scenarios ----


def node_terms(entities: Column, keyphrases: Column) -> Column:
    """Lower-cased entities, then keyphrases, each once; empty ones left out."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(entities, none), F.coalesce(keyphrases, none))
    return F.array_distinct(F.filter(F.transform(both, lambda x: strip(F.lower(x))), lambda x: x != ""))


# Styles and lengths of questions.
STYLES = ("perfect_grammar", "web_search_like", "misspelled", "poor_grammar")
LENGTHS = ("long", "medium", "short")


def prepare_combinations(triplets: DataFrame, key: str, combos: str, personas: DataFrame, styles: list[str] | None = None, lengths: list[str] | None = None) -> DataFrame:
    """key, combination, persona, nodes, style, length: all that a scenario of a triplet may be.

    triplets: key, combos (an array of arrays of themes), a, b, terms_a, terms_b. personas: persona, concepts; a handful, checked.
    A persona fits where a concept of it is in the combination, a node where a term of it is; where none fits, all do.
    Unknown styles and lengths are dropped; if none is known, all are used.
    """
    if personas.limit(1001).count() > 1000:
        raise ValueError("more than 1000 personas")
    known = lambda given, every: [x for x in given or [] if x in every] or list(every)
    low = lambda xs: F.transform(xs, F.lower)
    rows = triplets.select(key, "a", "b", "terms_a", "terms_b", F.explode(combos).alias("combination")).withColumn("_c", low(F.col("combination")))
    people = personas.agg(F.array_sort(F.collect_list(F.struct("persona", low(F.col("concepts")).alias("concepts")))).alias("_people"))  # one row
    rows = rows.join(F.broadcast(people))
    fits = F.filter("_people", lambda p: F.arrays_overlap(p["concepts"], F.col("_c")))
    rows = rows.withColumn("_p", F.transform(F.when(F.size(fits) > 0, fits).otherwise(F.col("_people")), lambda p: p["persona"]))
    held = [F.when(F.arrays_overlap(low(F.col(f"terms_{s}")), F.col("_c")), F.col(s)) for s in "ab"]
    nodes = F.array_compact(F.array(*held))
    rows = rows.withColumn("nodes", F.when(F.size(nodes) > 0, nodes).otherwise(F.array("a", "b")))
    out = rows.select(key, "combination", "nodes", F.explode("_p").alias("persona"))
    options = F.flatten(F.transform(F.lit(known(styles, STYLES)), lambda s: F.transform(F.lit(known(lengths, LENGTHS)), lambda n: F.struct(s.alias("style"), n.alias("length")))))
    return out.select("*", F.explode(options).alias("o")).select(key, "combination", "nodes", "persona", "o.style", "o.length")


def sample_one(options: DataFrame, key: str) -> DataFrame:
    """One option of every key: the smallest by a hash of key and option, so that any run picks the same."""
    rest = [c for c in options.columns if c != key]
    h = F.xxhash64(key, F.to_json(F.struct(*rest)))
    best = options.groupBy(key).agg(F.min(F.struct(h.alias("h"), F.struct(*rest).alias("o"))).alias("m"))
    return best.select(key, "m.o.*")


def qualify_types(subtype: Column, configured: dict[str, list[str]], built_in: dict[str, list[str]], answered: Column, taxonomy: list[str]) -> Column:
    """Types by the configured map, else the built-in one, else as answered, else all; only those of the taxonomy, all if none."""
    by = lambda m: F.coalesce(*[F.when(subtype == k, F.array(*[F.lit(t) for t in v])) for k, v in m.items()], F.lit(None).cast("array<string>"))
    every = F.array(*[F.lit(t) for t in taxonomy])
    return qualified(F.coalesce(by(configured), by(built_in), F.when(F.size(answered) > 0, answered), every), taxonomy)


def parse_types(reply: Column, valid: list[str]) -> Column:
    """Types named in a model's reply: the JSON array or that of the field compatible_types, else any quoted words; valid ones once."""
    bare = strip(F.regexp_replace(F.regexp_replace(reply, r"(?m)^\s*```[A-Za-z]*\s*$", ""), "```", ""))
    listed = F.coalesce(F.from_json(bare, "array<string>"), F.from_json(bare, "struct<compatible_types:array<string>>")["compatible_types"])
    quoted = F.regexp_extract_all(bare, F.lit('"([A-Za-z_]+)"'), F.lit(1))
    clean = lambda xs: F.array_distinct(F.filter(F.transform(xs, lambda x: strip(F.lower(x))), lambda x: x.isin(*valid)))
    return F.when(F.size(clean(listed)) > 0, clean(listed)).otherwise(clean(quoted))


def without_hop_label(context: Column) -> Column:
    return F.regexp_replace(context, r"(?i)^<\d+-hop>\s*", "")


def qualify_requests(rows: DataFrame, contexts: str, most: int = 3000) -> DataFrame:
    """rows with context_1 and context_2 for a qualifying model: no hop label, at most `most` characters."""
    one = lambda k: F.substring(without_hop_label(F.coalesce(F.get(contexts, F.lit(k)), F.lit(""))), 1, most)
    return rows.withColumn("context_1", one(0)).withColumn("context_2", one(1))


UNLIMITED = 999_999


def limited(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n by order; n <= 0 or n >= UNLIMITED: all."""
    return rows.orderBy(*order) if n <= 0 or n >= UNLIMITED else rows.orderBy(*order).limit(n)


def request_size(n: int, buffer_ratio: float = 0.5, target_only_passed: bool = True) -> int:
    """How many scenarios to ask for so that n questions are left."""
    ratio = max(1.0, buffer_ratio) if target_only_passed else buffer_ratio
    return n + max(5, int(n * ratio))


def scenario_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no checkpoint has."""
    return rows.join(done.select(key), key, "left_anti")


def rebuilt_counts(questions: DataFrame, kind: str, budget: DataFrame) -> DataFrame:
    """kind and n of every type of the budget, from questions that exist; unknown types don't count."""
    counts = questions.groupBy(kind).agg(F.count("*").alias("n"))
    return budget.select(kind).join(counts, kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))
