"""Keyphrases, similarity joins, edges, scenarios, budgets and judging, as DataFrame algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.products import joinable, products
from weftgraph.storage import cut

SEMANTIC = ("agent_discovered", "keyphrases_overlap", "cosine_similarity", "llm_triplet", "retrospective_entity")


# ---- keyphrases ----


def post_filter(phrases: Column, banned_words: list[str], banned_phrases: list[str]) -> Column:
    """Without banned words or phrases, phrases of banned words only, very short or all-digit ones."""
    words, whole = F.array(*[F.lit(x) for x in banned_words]), F.array(*[F.lit(x) for x in banned_phrases])

    def stays(p: Column) -> Column:
        low = F.lower(F.trim(p))
        parts = F.split(low, r"[\s_-]+")
        return ~F.array_contains(whole, low) & ~F.array_contains(words, low) & ~F.forall(parts, lambda t: F.array_contains(words, t)) & (F.length(low) >= 3) & ~low.rlike("^[0-9]+$")

    return F.filter(phrases, stays)


def idf_prune(rows: DataFrame, doc: str, phrase: str, least: float = 0.693) -> DataFrame:
    """Rows of phrases with ln(n / df) >= least; n is the number of documents with a phrase."""
    pairs = rows.select(doc, phrase).distinct()
    df = pairs.groupBy(phrase).agg(F.count("*").alias("df"))
    n = pairs.agg(F.countDistinct(doc).alias("n"))  # one row
    kept = df.join(F.broadcast(n)).withColumn("idf", F.ln(F.col("n") / F.col("df"))).filter((F.col("n") <= 1) | (F.col("idf") >= least))
    return pairs.join(kept.select(phrase, "df", "idf"), phrase)


def shared_pairs(rows: DataFrame, doc: str, item: str, least: int = 1) -> DataFrame:
    """a < b with the number of items that they share: an equi-join on items, never a cross join.

    Where items are so common that it would look at more pairs than grow with the input, pairs are counted block by block.
    """
    r = cut(rows.select(doc, item).distinct(), "shared-items")
    if not joinable(r.groupBy(item).agg(F.count("*").alias("f")), r.count()):
        met = products(r.select(F.col(doc).alias("d"), F.col(item).alias("t"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("n")), lambda k, x, y: k >= least)
        return met.select("a", "b", F.col("k").cast("long").alias("shared"))
    left, right = r.select(F.col(doc).alias("a"), item), r.select(F.col(doc).alias("b"), item)
    return left.join(right, item).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def too_common(sets: DataFrame, items: str, least: float = 0.693) -> list[str]:
    """Items that idf_prune takes away, from sets of distinct items: ln(n / df) < least, n being the sets that hold any.

    Each is in more than a fixed share of the sets, so they number at most 2 (e ** least) times the mean size of a set.
    """
    n = sets.filter(F.size(items) > 0).count()
    df = sets.select(F.explode(items).alias("i")).groupBy("i").agg(F.count("*").alias("df"))
    return [r.i for r in df.filter(F.ln(F.lit(n) / F.col("df")) < least).collect()] if n > 1 else []


def _kth(found: list[tuple[int, int]], k: int) -> int:
    """The k-th largest of values that each stand for a number of pairs; 1 if there are fewer."""
    for value, pairs in sorted(found, reverse=True):
        k -= pairs
        if k <= 0:
            return max(1, value)
    return 1


def top_shared_pairs(sets: DataFrame, node: str, doc: str, items: str, k: int) -> DataFrame:
    """The k pairs a < b of nodes of different documents that share most items, ties by a and b: exact.

    sets has one row per node, with distinct items. Nodes with equal sets are one class, and classes are paired. Pairs that
    are easily found (equal sets, and the two ends of an item's classes) give a count that k pairs reach; below it nothing
    can be among the first k, so a pair of classes must share an item among each one's first m - count + 1 of its m shared
    items, rarest first. What that proposes is counted in full. Of a class in a result, the first k nodes of each of its
    first k + 1 documents are enough: before any other one, k nodes of the class pair with the same partner.
    """
    full = sets.select(F.col(node).alias("node"), F.col(doc).alias("doc"), F.array_sort(items).alias("items")).withColumn("n", F.size("items")).filter("n > 0")
    keyed = full.withColumn("cls", F.md5(F.encode(F.to_json("items"), "UTF-8")))
    rows = cut(keyed.drop("items"), "top-rows")
    alike = cut(rows.groupBy("cls").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("node").alias("node"), F.first("n").alias("n")), "top-alike")
    copies = alike.filter("lo <> hi").select("cls", F.col("n").alias("shared"))
    equal = [(r.shared, 1) for r in copies.orderBy(F.desc("shared")).limit(k).collect()]
    # smaller classes can't reach the count; only of the others sets are carried, each one's once
    large = alike.filter(F.col("n") >= _kth(equal, k)).select("cls", "lo", "hi", "node")
    classes = cut(large.join(full.filter(F.col("n") >= _kth(equal, k)).select("node", "items", "n"), "node").drop("node"), "top-classes")

    def held(least: int) -> DataFrame:
        return classes.filter(F.col("n") >= least).select("cls", "lo", "hi", F.explode("items").alias("i"))

    def counted(pairs: DataFrame, least: int) -> DataFrame:
        one = lambda s: classes.filter(F.col("n") >= least).select(F.col("cls").alias(s), F.col("items").alias(f"items_{s}"))
        return pairs.join(one("x"), "x").join(one("y"), "y").select("x", "y", F.size(F.array_intersect("items_x", "items_y")).alias("shared"))

    ends = held(_kth(equal, k)).groupBy("i").agg(F.min(F.struct("cls", "lo", "hi")).alias("p"), F.max(F.struct("cls", "lo", "hi")).alias("q"))
    ends = ends.filter("p.cls <> q.cls and (p.lo <> q.hi or p.hi <> q.lo)").groupBy(F.col("p.cls").alias("x"), F.col("q.cls").alias("y")).agg(F.count("*").alias("seen"))
    likely = ends.orderBy(F.desc("seen"), "x", "y").limit(10 * k).select("x", "y")
    least = _kth(equal + [(r.shared, 1) for r in counted(F.broadcast(likely), 1).collect()], k)

    some = held(least)
    freq = some.groupBy("i").agg(F.count("*").alias("f")).filter("f > 1")
    own = Window.partitionBy("cls")
    ranked = some.join(freq, "i").withColumn("m", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("f", "i")))
    first = cut(ranked.filter(F.col("place") <= F.col("m") - least + 1).select("cls", "lo", "hi", "i", "m", "place"), "top-first")
    left, right = [first.select("i", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "lo", "hi", "m", "place")]) for s in "xy"]
    rest = 1 + F.least(F.col("m_x") - F.col("place_x"), F.col("m_y") - F.col("place_y"))
    near = left.join(right, "i").filter((F.col("cls_x") < F.col("cls_y")) & ((F.col("lo_x") != F.col("hi_y")) | (F.col("hi_x") != F.col("lo_y"))))
    # an item is the first one shared only where enough places follow it; a pair's first one passes
    near = near.filter(rest >= least).select(F.col("cls_x").alias("x"), F.col("cls_y").alias("y")).distinct()
    found = counted(near, least).unionByName(copies.select(F.col("cls").alias("x"), F.col("cls").alias("y"), "shared"))
    found = cut(found.filter(F.col("shared") >= least), "top-found")
    least = _kth([(r.shared, 1) for r in found.orderBy(F.desc("shared")).limit(k).collect()], k)
    found = found.filter(F.col("shared") >= least)

    named = found.select(F.col("x").alias("cls")).union(found.select("y")).distinct()
    nodes = rows.select("cls", "doc", "node").join(named, "cls").withColumn("nth", F.row_number().over(Window.partitionBy("cls", "doc").orderBy("node"))).filter(F.col("nth") <= k)
    per_doc = nodes.groupBy("cls", "doc").agg(F.min("node").alias("first"), F.collect_list("node").alias("nodes"))
    per_doc = per_doc.withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy("first"))).filter(F.col("nth") <= k + 1)
    kept = per_doc.select("cls", "doc", F.explode("nodes").alias("node"))
    left, right = [kept.select(F.col("cls").alias(s), F.col("doc").alias(f"doc_{s}"), F.col("node").alias(f"node_{s}")) for s in "xy"]
    out = found.join(left, "x").join(right, "y").filter("doc_x <> doc_y and (x <> y or node_x < node_y)")
    return out.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), "shared").orderBy(F.desc("shared"), "a", "b").limit(k)


# ---- edges ----


def edge_key(a: Column, b: Column, kind: Column, theme: Column) -> Column:
    typed = F.when(kind == "agent_discovered", F.concat(kind, F.lit(":"), F.coalesce(theme, F.lit("")))).otherwise(kind)
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"), typed)


def validate_edges(edges: DataFrame, verdicts: DataFrame, on: str, threshold: float = 0.5) -> DataFrame:
    """No verdict, a reliable one or one without confidence keeps an edge; kept as a flag."""
    out = edges.join(verdicts, on, "left")
    return out.withColumn("keeps", F.coalesce("is_reliable", F.lit(True)) | F.coalesce(F.col("confidence") < threshold, F.lit(True)))


def item_registry(rows: DataFrame, item: str, doc: str, least: int = 2) -> DataFrame:
    """Items in at least `least` documents: their number, first and last."""
    per = rows.select(item, doc).distinct().groupBy(item)
    return per.agg(F.count("*").alias("n_docs"), F.min(doc).alias("first_doc"), F.max(doc).alias("last_doc")).filter(F.col("n_docs") >= least)


def concept_bridges(rows: DataFrame, concept: str, chunk: str, share: float = 0.5) -> DataFrame:
    """Concepts in 2 to max(2, share of all chunks) chunks."""
    n = rows.agg(F.countDistinct(chunk).alias("n"))
    per = rows.groupBy(concept).agg(F.countDistinct(chunk).alias("n_chunks"))
    return per.join(F.broadcast(n)).filter((F.col("n_chunks") >= 2) & (F.col("n_chunks") <= F.greatest(F.lit(2), F.floor(F.col("n") * share)))).select(concept, "n_chunks")


def next_chunk(rows: DataFrame, doc: str, order: str) -> DataFrame:
    w = Window.partitionBy(doc).orderBy(order)
    return rows.select(doc, F.col(order).alias("src"), F.lead(order).over(w).alias("dst")).filter("dst is not null")


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    ends = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


# ---- scenarios ----


def priority(kind: Column, validated: Column, confidence: Column) -> Column:
    return F.when(kind == "agent_discovered", 0).when(kind == "retrospective_entity", 1).when(validated & (confidence >= 0.7), 2).when(validated, 3).otherwise(4)


def round_robin(rows: DataFrame, bucket: str, order: str) -> DataFrame:
    """One of each bucket per round, buckets by name: rows in that order, with their round.

    A bucket's rows are numbered by range: counts per range of the order column, which are few, give where each range begins,
    so a bucket with most of the rows is as many tasks as it fills.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, bucket, order).sortWithinPartitions(bucket, order).withColumn("_part", F.spark_partition_id()), "round-robin")
    sizes = ranged.groupBy(bucket, "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(bucket).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(bucket).alias("_bucket"), F.col("_part").alias("_p"), before.alias("_before"))
    # at most a row per bucket and range: buckets plus n
    own = F.row_number().over(Window.partitionBy(bucket, "_part").orderBy(order))
    numbered = ranged.withColumn("_nth", own).join(starts, F.col(bucket).eqNullSafe(F.col("_bucket")) & (F.col("_part") == F.col("_p")))
    return numbered.withColumn("round", (F.col("_before") + F.col("_nth")).cast("int")).drop("_part", "_p", "_bucket", "_before", "_nth").orderBy("round", bucket)


def first_of_pair(rows: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Of rows with the same unordered pair the first."""
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def budget_report(rows: DataFrame, kind: str, budget: DataFrame) -> DataFrame:
    """kind, count, actual and target share, also of kinds that have no row."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    out = budget.join(counts, kind, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row per kind
    return out.select(kind, "n", (F.col("n") / F.greatest(total, F.lit(1))).alias("actual"), "target")


# ---- judging ----


def clamp(x: Column) -> Column:
    """Into [0, 1]; null, NaN and infinity count as 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def judge(groundedness: Column, raw_accuracy: Column, needs_both: Column, uses_both: Column, threshold: float = 0.8) -> dict[str, Column]:
    """The three scores, whether all pass, and whether the question itself is at fault."""
    ground, needs, uses = clamp(groundedness), clamp(needs_both), clamp(uses_both)
    missing = raw_accuracy.isNull() | F.isnan(raw_accuracy.cast("double"))
    accuracy = F.when(missing, 0.0).otherwise(1 - clamp(raw_accuracy))
    two_hop = (needs + uses) / 2
    return {
        "groundedness_score": ground,
        "answer_accuracy_score": accuracy,
        "two_hop_score": two_hop,
        "passed": (ground >= threshold) & (accuracy >= threshold) & (two_hop >= threshold),
        "question_is_faulty": needs < threshold,
        "query_signal": F.array(needs, ground),
        "answer_signal": F.array(ground, accuracy, uses),
    }


def best_attempt(rows: DataFrame, question: str, attempt: str, passed: str) -> DataFrame:
    """The first attempt that passed, else the last one."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    w = Window.partitionBy(question).orderBy(ok.desc(), F.when(ok, F.col(attempt)).otherwise(-F.col(attempt)))
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def target_prefix(rows: DataFrame, group: str, order: str, passed: str, n: int) -> DataFrame:
    """Rows of each group until n are not false."""
    valid = F.coalesce(F.col(passed), F.lit(True)).cast("int")
    before = F.coalesce(F.sum(valid).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).filter(F.col("_before") < n).drop("_before")


def hop_context(k: int, breadcrumb: Column, body: Column, most: int = 12000) -> Column:
    return F.concat(F.lit(f"<{k}-hop>\n"), F.substring(F.concat_ws("\n\n", F.nullif(breadcrumb, F.lit("")), body), 1, most))
