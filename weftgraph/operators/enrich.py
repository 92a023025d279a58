"""Edges found in a graph of chunks: keyphrase filters, themes and bridges, frames, concepts, entities, centrality.

Chunks are rows of node, doc, breadcrumb, content and more; what a model says comes as columns (weftgraph.annotate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import normalize_ws, strip
from weftgraph.operators.graph import edge_key
from weftgraph.storage import cut

# Words and phrases that are no keyphrases, structural terms, tokens that say nothing in a frame.
BANNED_WORDS = ("method", "function", "class", "instance", "attribute", "parameter", "argument", "value", "default", "setup", "compute", "return", "object", "system", "type", "name", "data", "code", "input", "output", "example")
BANNED_PHRASES = (
    "compute method", "setup method", "return value", "default value", "input parameter", "output attribute", "type attribute", "name attribute", "system object", "child system",
    "parent system", "child systems", "parent systems", "list of dictionaries", "parameter named value", "function argument", "class instance", "code example",
)
STRUCTURAL_TERMS = ("code description", "output example", "example", "examples", "note", "notes", "see also", "overview", "introduction", "summary", "description", "table", "figure", "section", "chapter", "appendix", "e.g", "i.e")
NO_PHRASE = r"\d+\.?\d*|[a-z0-9]{1,2}|e\.?g\.?|i\.?e\.?|etc\.?|vs\.?|fig\.?|eq\.?"
GENERIC_TOKENS = (
    "n/a", "always", "value", "result", "method", "data", "system", "process", "output", "input", "default", "compute", "function", "object", "class", "module", "parameter", "configuration",
    "component", "interface", "service", "handler", "manager", "controller", "entity", "model", "instance", "type", "state", "request", "response", "returns", "creates", "updates", "the",
    "a", "an", "is", "are", "it", "its", "this", "that", "and", "or",
)
SLOTS = ("subject", "operation", "object", "result")


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# ---- keyphrases ----


def eligible(phrases: Column, least: int = 3) -> Column:
    """Whether a chunk has more than `least` keyphrases."""
    return F.coalesce(F.size(phrases) > least, F.lit(False))


def without_blacklisted(phrases: Column, blacklist=STRUCTURAL_TERMS, patterns: tuple[str, ...] = ()) -> Column:
    """Without blacklisted phrases, numbers, one or two characters, abbreviations, and what one of the patterns matches whole."""
    rule = f"(?i)^(?:{'|'.join([NO_PHRASE, *[f'(?:{p})' for p in patterns]])})$"
    return F.filter(phrases, lambda p: ~F.array_contains(literals(blacklist), F.lower(strip(p))) & ~strip(p).rlike(rule))


def document_of(metadata_filename: Column, filename: Column, parent_doc: Column, node: Column) -> Column:
    """The first that isn't empty; else the first 8 characters of the node's id."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (metadata_filename, filename, parent_doc)], F.substring(node.cast("string"), 1, 8))


def inverted_index(rows: DataFrame, item: str, node: str, parts: int = 16) -> DataFrame:
    """item, part, nodes (sorted) and n: postings in `parts` parts each, so that one of a common item stays small."""
    spread = rows.select(item, node).distinct().withColumn("part", F.pmod(F.xxhash64(node), F.lit(parts)).cast("int"))
    return spread.groupBy(item, "part").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.count("*").alias("n"))


def shared_keyphrases(edges: DataFrame, chunks: DataFrame, node: str, phrases: str) -> DataFrame:
    """edges (a, b) with shared_keyphrases, the sorted exact intersection of both chunks' keyphrases, and shared_count."""
    one = lambda s: chunks.select(F.col(node).alias(s), F.coalesce(F.col(phrases), literals([])).alias(f"_p_{s}"))
    both = edges.join(one("a"), "a").join(one("b"), "b")
    shared = F.array_sort(F.array_intersect("_p_a", "_p_b"))
    return both.select(*edges.columns, shared.alias("shared_keyphrases"), F.size(shared).cast("long").alias("shared_count"))


# ---- edges ----


def of_different_documents(doc_a: Column, doc_b: Column) -> Column:
    """Whether two documents differ; an unknown one differs from all."""
    return doc_a.isNull() | doc_b.isNull() | (doc_a != doc_b)


def without_modules(edges: DataFrame, disabled: list[str], kind: str = "type") -> DataFrame:
    """Edges but those of disabled types; only similarity edges can be disabled."""
    off = [t for t in disabled if t in ("keyphrases_overlap", "cosine_similarity")]
    return edges.filter(~F.col(kind).isin(*off)) if off else edges


def missing_semantic_types(edges: DataFrame, wanted: list[str], kind: str = "type") -> list[str]:
    """Wanted types that no edge has; a row per wanted type reaches the driver."""
    have = {r[0] for r in edges.filter(F.col(kind).isin(*wanted)).select(kind).distinct().collect()}
    return [t for t in wanted if t not in have]


def new_edges(candidates: DataFrame, existing: DataFrame, order: str, theme: str = "shared_theme") -> DataFrame:
    """Candidates whose key no existing edge has; of several with one key the first. Columns: a, b, type and the theme."""
    keyed = lambda d: d.withColumn("_key", edge_key(F.col("a"), F.col("b"), F.col("type"), F.col(theme) if theme in d.columns else F.lit(None).cast("string")))
    first = keyed(candidates).withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(order))).filter("_nth = 1").drop("_nth")
    return first.join(keyed(existing).select("_key"), "_key", "left_anti").drop("_key")


def contains_edges(chunks: DataFrame, doc: str, node: str, index: str) -> DataFrame:
    return chunks.select(F.col(doc).alias("a"), F.col(node).alias("b"), F.lit("contains").alias("type"), F.col(index).alias("order"))


def best_content(summary: Column, raw: Column, page: Column, most: int) -> Column:
    """The summary whole; without one, the raw or else the page's content up to `most` characters."""
    return F.coalesce(F.nullif(summary, F.lit("")), F.substring(F.coalesce(F.nullif(raw, F.lit("")), page, F.lit("")), 1, most))


def chunks_by_document(chunks: DataFrame, doc: str, index: str, *columns: str) -> DataFrame:
    """doc and chunks, an array of the columns in the order of index: a document's chunks."""
    return chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(index, *columns))).alias("chunks"))


def doc_preview(chunks: DataFrame, doc: str, index: str, breadcrumb: str, content: str, words: int = 120) -> DataFrame:
    """doc and preview: per chunk its path in brackets and the first words of its content, chunks apart by a blank line."""
    excerpt = F.array_join(F.slice(F.filter(F.split(F.col(content), r"[\s\p{Z}]+"), lambda x: x != ""), 1, words), " ")
    line = F.concat(F.lit("["), F.coalesce(F.col(breadcrumb), F.lit("?")), F.lit("]\n"), excerpt)
    per = chunks.select(doc, index, line.alias("line")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(index, "line"))).alias("l"))
    return per.select(doc, F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("preview"))


def validator_requests(edges: DataFrame, chunks: DataFrame, node: str, content: str, breadcrumb: str, most: int = 4000) -> DataFrame:
    """edges (a, b) with what a validator reads of both ends: content up to `most` characters and the path."""
    one = lambda s: chunks.select(F.col(node).alias(s), F.substring(content, 1, most).alias(f"content_{s}"), F.coalesce(F.col(breadcrumb), F.lit("")).alias(f"breadcrumb_{s}"))
    return edges.join(one("a"), "a").join(one("b"), "b")


def validation_stats(edges: DataFrame, keeps: str = "keeps", judged: str = "is_reliable") -> DataFrame:
    """checked, kept, removed and without_verdict in one row."""
    return edges.agg(F.count("*").alias("checked"), F.count_if(F.col(keeps)).alias("kept"), F.count_if(~F.col(keeps)).alias("removed"), F.count_if(F.col(judged).isNull()).alias("without_verdict"))


# ---- themes and bridges ----


def first_themes(themes: Column, most: int = 5) -> Column:
    return F.slice(themes, 1, most)


def theme_registry(rows: DataFrame, theme: str, doc: str, parts: int = 16) -> DataFrame:
    """theme, part, doc_ids and n_docs (of all parts): the distinct documents of every theme, in parts of bounded share."""
    index = inverted_index(rows, theme, doc, parts)
    total = index.groupBy(theme).agg(F.sum("n").alias("n_docs"))
    return index.join(total, theme).select(theme, "part", F.col("nodes").alias("doc_ids"), "n_docs")


def valid_bridges(bridges: DataFrame, bridge: str, doc_ids: str, docs: DataFrame, doc: str, least: int = 2) -> DataFrame:
    """bridge, doc and doc_pos (from 0, as named) of bridges with at least `least` documents that exist; repeats count."""
    rows = bridges.select(bridge, F.posexplode(doc_ids).alias("doc_pos", "doc"))
    rows = rows.join(docs.select(F.col(doc).alias("_d")).distinct(), F.col("doc") == F.col("_d"), "left_semi")
    enough = rows.groupBy(bridge).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return rows.join(enough, bridge, "left_semi")


def located_chunks(answers: DataFrame, bridge: str, doc: str, indices: str, n_chunks: str, most: int = 2) -> DataFrame:
    """bridge, doc and chunk_index of the first `most` valid indices that a locator named for a document."""
    valid = F.filter(indices, lambda i: (i >= 0) & (i < F.col(n_chunks)))
    rest = [c for c in answers.columns if c not in (indices, n_chunks)]
    return answers.select(*rest, F.explode(F.slice(valid, 1, most)).alias("chunk_index"))


#: Rows that one task joins with each other, on average and at most.
TASK_ROWS = 250_000


def bridge_pairs(located: DataFrame, bridge: str, doc: str, pos: str, node: str) -> DataFrame:
    """bridge, a, b: the located chunks of every two documents of a bridge, in the documents' order.

    At most two chunks per document are located, and a model names a bridge's documents, so a bridge is a short list. Bridges
    are dealt to as many tasks as rows ask for: what one task sorts and makes distinct does not grow with the input.
    """
    n = max(int(located.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-located.count() // TASK_ROWS))
    dealt = located.select(bridge, pos, node).repartition(n, bridge)
    left = dealt.select(bridge, F.col(pos).alias("_p"), F.col(node).alias("a"))
    right = dealt.select(bridge, F.col(pos).alias("_q"), F.col(node).alias("b"))
    return left.join(right, bridge).filter("_p < _q and a <> b").select(bridge, "a", "b").distinct()


def accepted(pairs: DataFrame, valid: Column, confidence: Column, least: float) -> DataFrame:
    """Pairs that a validator calls valid with enough confidence; without an answer they go."""
    return pairs.filter(F.coalesce(valid & (confidence >= least), F.lit(False)))


# ---- frames ----


def slot_tokens(value: Column) -> Column:
    """The distinct lower-cased tokens of a slot but generic ones; commas are blanks."""
    words = F.filter(F.split(F.lower(F.replace(F.coalesce(value, F.lit("")), F.lit(","), F.lit(" "))), r"[\s\p{Z}]+"), lambda t: t != "")
    return F.array_except(F.array_distinct(words), literals(GENERIC_TOKENS))


def kept_frames(frames: Column, most: int = 3) -> Column:
    """The first frames but those whose subject and operation are both generic."""
    return F.slice(F.filter(frames, lambda f: (F.size(slot_tokens(f["subject"])) > 0) | (F.size(slot_tokens(f["operation"])) > 0)), 1, most)


def frame_overlap_join(frames: DataFrame, node: str, doc: str, index: str, covered: DataFrame | None = None, least: float = 0.30, slots: int = 2) -> DataFrame:
    """a < b and concept of chunks of different documents with frames that agree in `slots` slots or more.

    frames: rows of node, doc, index (order in the chunk), subject, operation, object, result. Slots agree if the Jaccard
    similarity of their tokens is at least `least`. Candidates share a slot's token; all shared ones are counted, which gives
    the similarity with the slots' sizes. The first pair of frames counts; its concept is up to four shared tokens of the
    subject, else of the operation, else a's subject. covered: pairs a, b that are left out.
    """
    wide = frames.select(F.col(node).alias("node"), F.col(doc).alias("doc"), F.col(index).alias("i"), "subject", *[slot_tokens(F.col(s)).alias(f"t_{s}") for s in SLOTS])
    wide = cut(wide, "frames")
    tall = wide.select("node", "doc", "i", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"t_{s}").alias("t")) for s in SLOTS])).alias("s")).select("node", "doc", "i", "s.slot", F.size("s.t").alias("n"), F.explode("s.t").alias("token"))
    one = lambda s: tall.select("slot", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "doc", "i", "n")])
    met = one("a").join(one("b"), ["slot", "token"]).filter((F.col("node_a") < F.col("node_b")) & of_different_documents(F.col("doc_a"), F.col("doc_b")))
    key = ["node_a", "node_b", "i_a", "i_b"]
    agree = met.groupBy(*key, "slot", "n_a", "n_b").agg(F.count("*").alias("k")).filter(F.col("k") / (F.col("n_a") + F.col("n_b") - F.col("k")) >= least)
    pairs = agree.groupBy(*key).agg(F.count("*").alias("n_slots")).filter(F.col("n_slots") >= slots)
    first = pairs.groupBy("node_a", "node_b").agg(F.min(F.struct("i_a", "i_b")).alias("f"))
    if covered is not None:
        done = covered.select(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b"))
        first = first.join(done, ["node_a", "node_b"], "left_anti")
    side = lambda s: wide.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "i", "subject", "t_subject", "t_operation")])
    both = first.select("node_a", "node_b", "f.i_a", "f.i_b").join(side("a"), ["node_a", "i_a"]).join(side("b"), ["node_b", "i_b"])
    shared = [F.array_sort(F.array_intersect(f"t_{s}_a", f"t_{s}_b")) for s in ("subject", "operation")]
    named = [F.when(F.size(x) > 0, F.array_join(F.slice(x, 1, 4), " ")) for x in shared]
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.coalesce(*named, "subject_a").alias("concept"))


def frame_text(frames: Column) -> Column:
    """All frames of a chunk as one text, for an embedding."""
    slots = ("subject", "operation", "object", "condition", "result")
    return F.array_join(F.transform(frames, lambda f: F.concat_ws(" ", *[f[s] for s in slots])), " | ")


def frame_embedding_filter(pairs: DataFrame, vectors: DataFrame, node: str, vector: str, least: float = 0.25, from_count: int = 20) -> DataFrame:
    """Pairs (a, b) whose vectors' cosine is at least `least`; with from_count pairs or fewer, all of them."""
    if pairs.limit(from_count + 1).count() <= from_count:
        return pairs
    one = lambda s: vectors.select(F.col(node).alias(s), F.col(vector).alias(f"_v_{s}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = lambda v: F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))  # noqa: E731  a vector of zeros has the length 1
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    return both.withColumn("_c", dot(F.col("_v_a"), F.col("_v_b")) / (norm(F.col("_v_a")) * norm(F.col("_v_b")))).filter(F.col("_c") >= least).select(*pairs.columns)


# ---- concepts and entities ----


def normalize_concept(text: Column) -> Column:
    return normalize_ws(text)


def distinct_concepts(concepts: Column) -> Column:
    """Normalised concepts in the order they were first seen, empty ones left out."""
    return F.array_distinct(F.filter(F.transform(concepts, normalize_concept), lambda c: c != ""))


def bridge_chunks(rows: DataFrame, concept: str, chunk: str, most: int = 12) -> DataFrame:
    """concept and chunk of the first `most` chunks of every concept, by id: a concept's request to a model holds no more."""
    w = Window.partitionBy(concept).orderBy(chunk)
    return rows.select(concept, chunk).distinct().withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= most).drop("_nth")


def concept_relations(answers: DataFrame, chunks: DataFrame, node: str, doc: str, order: str, least: float = 0.6, cross_doc: bool = False) -> DataFrame:
    """Answers (a, b, confidence and more) with enough confidence whose ends exist and differ, the first of every pair."""
    one = lambda s: chunks.select(F.col(node).alias(s), F.col(doc).alias(f"_doc_{s}"))
    known = answers.filter((F.col("confidence") >= least) & (F.col("a") != F.col("b"))).join(one("a"), "a").join(one("b"), "b")
    if cross_doc:
        known = known.filter(of_different_documents(F.col("_doc_a"), F.col("_doc_b")))
    w = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(order)
    return known.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select(*answers.columns)


def entity_edges(rows: DataFrame, node: str, doc: str, entity: str, least_chars: int = 3, share: float = 0.5, most: int = 3) -> DataFrame:
    """a < b of different documents with the rarest entity that they share: at most `most` edges per chunk, rarest entities first.

    Entities of fewer characters, or in more than `share` of the chunks, make no edge. Of an entity's chunks each is linked
    with the next one of another document in the order of ids, so a common entity makes a chain and not all pairs.
    """
    r = rows.select(F.col(node).alias("node"), F.col(doc).alias("doc"), F.lower(strip(F.col(entity))).alias("entity")).filter(F.length("entity") >= least_chars).distinct()
    n = rows.select(node).distinct().agg(F.count("*").alias("n"))  # one row
    df = r.groupBy("entity").agg(F.count("*").alias("df")).join(F.broadcast(n)).filter((F.col("df") >= 2) & (F.col("df") <= share * F.col("n")))
    # the next chunk of another document: by document, the first of the one that follows
    firsts = r.groupBy("entity", "doc").agg(F.min("node").alias("first"))
    following = firsts.withColumn("next", F.lead("first").over(Window.partitionBy("entity").orderBy("doc"))).select("entity", "doc", "next")
    met = r.join(df.select("entity", "df"), "entity").join(following, ["entity", "doc"]).filter("next is not null")
    rare = met.withColumn("_nth", F.row_number().over(Window.partitionBy("node").orderBy("df", "entity"))).filter(F.col("_nth") <= most)
    pairs = rare.groupBy(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b")).agg(F.min(F.struct("df", "entity")).alias("e"))
    return pairs.select("a", "b", F.col("e.entity").alias("entity"), F.col("e.df").alias("df"))


def graph_totals(nodes: DataFrame, edges: DataFrame, semantic: tuple[str, ...], kind: str = "type") -> DataFrame:
    """measure and n: nodes, documents, chunks, edges, edges by type, semantic edges."""
    by_node = nodes.groupBy(kind).agg(F.count("*").alias("n"))
    by_edge = edges.groupBy(kind).agg(F.count("*").alias("n"))
    tally = lambda d, name, rule: d.agg(F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0)).alias("n")).select(F.lit(name).alias("measure"), "n")
    parts = [tally(by_node, "nodes", F.lit(True)), tally(by_node, "documents", F.col(kind) == "DOCUMENT"), tally(by_node, "chunks", F.col(kind) == "CHUNK")]
    parts += [tally(by_edge, "edges", F.lit(True)), tally(by_edge, "semantic_edges", F.col(kind).isin(*semantic)), by_edge.select(F.concat(F.lit("edges:"), F.col(kind)).alias("measure"), "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pagerank(edges: DataFrame, a: str, b: str, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """node and rank of an undirected graph after `rounds` rounds; ranks sum to 1. Each round is a join by node and a table."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).filter("u <> v").distinct()
    both = cut(both.join(both.groupBy("u").agg(F.count("*").alias("deg")), "u"), "pagerank-edges")
    ranks = both.select(F.col("u").alias("node")).distinct()
    n = ranks.count()
    ranks = cut(ranks.withColumn("rank", F.lit(1.0 / max(1, n))), "pagerank")
    for _ in range(rounds):
        sent = both.join(ranks, F.col("u") == F.col("node")).groupBy("v").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        # every node has a neighbour, so every node is sent something
        ranks = cut(sent.select(F.col("v").alias("node"), (F.lit((1 - damping) / n) + damping * F.col("got")).alias("rank")), "pagerank")
    return ranks
