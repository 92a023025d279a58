"""Similarity joins: candidates by equi-joins on rare items, then exact verification. No cross joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftgraph.functions.text import jaccard, tokens
from weftgraph.operators.products import JOINED, joinable, products
from weftgraph.storage import block_files, cut, cut_blocks, open_blocks

#: Vectors of one block of the dense join; a task holds two blocks.
BLOCK_ROWS = 4096
#: Most centres that vectors are dealt to; centres and their radii are all that reaches the driver.
CENTRES = 256


def _by_rarity(rows: DataFrame, doc: str, item: str) -> DataFrame:
    """d, items (rarest first) and n: one row per set."""
    r = rows.select(F.col(doc).alias("d"), F.col(item).alias("i")).distinct()
    freq = r.groupBy("i").agg(F.count("*").alias("f"))
    sets = r.join(freq, "i").groupBy("d").agg(F.array_sort(F.collect_list(F.struct("f", "i"))).alias("s"))
    return cut(sets.select("d", F.transform("s", lambda x: x["i"]).alias("items"), F.size("s").alias("n")), "sets")


def jaccard_join(rows: DataFrame, doc: str, item: str, least: float) -> DataFrame:
    """a < b and their Jaccard similarity, at least `least` (> 0): prefix, length and positional filters, then exact.

    Items are ordered rarest first; a pair that reaches the similarity shares an item among the first
    n - ceil(least * n) + 1 of each. Behind the first one shared there must be room for the overlap that is needed.
    Every set is one row; a candidate meets each of its two sets once. Where prefixes would meet in more than JOINED pairs
    for each set, which grow faster than the input, all pairs are multiplied block by block instead.
    """
    sets = _by_rarity(rows, doc, item)
    prefix = sets.select("d", "n", F.posexplode(F.slice("items", F.lit(1), F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1))).alias("pos", "i"))
    met = prefix.groupBy("i").agg(F.count("*").alias("f")).agg(F.sum(F.col("f") * F.col("f"))).first()[0] or 0
    if met > JOINED * sets.count():
        rows = sets.select("d", F.explode("items").alias("t"), F.lit(1.0).cast("float").alias("weight"), "n")
        met = products(rows, lambda k, x, y: k / (x + y - k) >= least, np.float32)
        return met.select("a", "b", (F.col("k") / (F.col("n_a") + F.col("n_b") - F.col("k"))).alias("jaccard"))
    left, right = [prefix.select("i", *[F.col(c).alias(f"{c}_{s}") for c in ("d", "n", "pos")]) for s in "xy"]
    need = F.ceil((F.col("n_x") + F.col("n_y")) * least / (1 + least) - 1e-9)
    room = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    fits = (F.col("d_x") < F.col("d_y")) & (F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y") - 1e-9) & (room >= need)
    near = left.join(right, "i").filter(fits).select(F.col("d_x").alias("a"), F.col("d_y").alias("b")).distinct()
    one = lambda s: sets.select(F.col("d").alias(s), F.col("items").alias(f"items_{s}"), F.col("n").alias(f"n_{s}"))
    both = near.join(one("a"), "a").join(one("b"), "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("items_a", "items_b")).alias("k"))
    return both.withColumn("jaccard", F.col("k") / (F.col("n_a") + F.col("n_b") - F.col("k"))).filter(F.col("jaccard") >= least).select("a", "b", "jaccard")


# ---- sparse vectors ----


def word_grams(text: Column) -> Column:
    """Lower-cased words of two or more word characters, and pairs of neighbours, in order with repeats."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    both = lambda w: F.concat(w, F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit("\x00")))), lambda g: ~g.endswith("\x00")))
    return F.transform(F.array(words), both)[0]


def tfidf(rows: DataFrame, doc: str, term: str) -> DataFrame:
    """Smoothed tf-idf of unit length: ln((1 + n) / (1 + df)) + 1 times the count."""
    tf = rows.groupBy(doc, term).agg(F.count("*").alias("tf"))
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    n = tf.select(doc).distinct().agg(F.count("*").alias("n"))
    w = tf.join(df, term).join(F.broadcast(n)).withColumn("weight", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(doc)))
    return w.select(doc, term, "df", (F.col("weight") / norm).alias("weight"))


def _dots(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for columns in parts:
        ta, wa, tb, wb = (c.to_pylist() for c in columns)
        out = []
        for a, x, b, y in zip(ta, wa, tb, wb, strict=True):
            own = dict(zip(a, x, strict=True))
            out.append(float(sum(own[t] * v for t, v in zip(b, y, strict=True) if t in own)))
        yield pa.array(out, pa.float64())


def cosine_terms(weights: DataFrame, doc: str, term: str, low: float, high: float) -> DataFrame:
    """a < b with low <= cosine <= high (0 < low) over vectors of unit length as rows of doc, term, weight.

    Terms are ordered rarest first. The rest of a vector behind a prefix has a length; where it is below low, no pair can
    reach low on terms of the rest alone, so the first shared term lies in both prefixes, and only prefixes are joined.
    """
    w = weights.select(F.col(doc).alias("d"), F.col(term).alias("t"), "weight", *(["df"] if "df" in weights.columns else []))
    if "df" not in weights.columns:
        w = w.join(w.groupBy("t").agg(F.count("*").alias("df")), "t")
    order = Window.partitionBy("d").orderBy("df", "t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = cut(w.withColumn("rest", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(order))), "weights")
    met = w.filter(F.col("rest") >= low - 1e-9).groupBy("t").agg(F.count("*").alias("f")).agg(F.sum(F.col("f") * F.col("f"))).first()[0] or 0
    # where prefixes leave more pairs than grow with the input (a low band), all pairs are multiplied block by block
    if met > JOINED * w.select("d").distinct().count():
        return products(w.withColumn("n", F.lit(1)), lambda k, x, y: (k >= low) & (k <= high)).select("a", "b", F.col("k").alias("cosine"))
    prefix = w.filter(F.col("rest") >= low - 1e-9)
    left, right = prefix.select(F.col("d").alias("a"), "t"), prefix.select(F.col("d").alias("b"), "t")
    near = left.join(right, "t").filter("a < b").select("a", "b").distinct()
    full = w.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("t", "weight"))).alias("v")).select("d", F.transform("v", lambda x: x["t"]).alias("ts"), F.transform("v", lambda x: x["weight"]).alias("ws"))
    full = cut(full, "vectors")
    one = lambda s: full.select(F.col("d").alias(s), F.col("ts").alias(f"t_{s}"), F.col("ws").alias(f"w_{s}"))
    both = near.join(one("a"), "a").join(one("b"), "b")
    dots = both.select("a", "b", F.arrow_udf(_dots, "double")("t_a", "w_a", "t_b", "w_b").alias("cosine"))
    return dots.filter(F.col("cosine").between(low, high))


# ---- dense vectors ----


def cosine_band(vectors: DataFrame, vec_id: str, vector: str, low: float, high: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a < b and the cosine of every pair with low <= cosine <= high; a vector of length zero has the cosine 0 with all.

    Exact. Vectors are dealt to the nearest of at most CENTRES centres, and a large cell to blocks of about block_rows.
    The angle between vectors of two cells is at least that of their centres less both radii, so pairs of cells beyond the
    band's widest angle are left out; the others meet block by block in a matrix product. Blocks are written once, and a
    task reads and holds two: no vector is sent to each pair of blocks.
    """
    unit = lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))[0]
    rows = cut(vectors.select(F.col(vec_id).alias("id"), unit(F.col(vector)).alias("v")), "unit-vectors")
    n = rows.count()
    if not n:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cosine"))
    k = min(CENTRES, max(1, int(n**0.5) // 4))
    # at most CENTRES vectors, the smallest by hash
    centres = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(k).select("v").collect()], np.float64)

    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            m = np.array(col.to_pylist(), np.float64).reshape(len(col), -1)
            dots = np.clip(m @ centres.T, -1, 1)
            own = dots.argmax(axis=1)
            angle = np.arccos(dots[np.arange(len(m)), own])
            yield pa.StructArray.from_arrays([pa.array(own, pa.int64()), pa.array(angle, pa.float64())], ["cell", "angle"])

    placed = cut(rows.select("id", "v", F.arrow_udf(near, "cell long, angle double")("v").alias("c")).select("id", "v", "c.*"), "placed-vectors")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("cell").collect()  # at most CENTRES rows
    parts = {c.cell: max(1, -(-c.n // block_rows)) for c in cells}
    base = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    pairs = []
    for x in cells:
        for y in cells:
            if x.cell <= y.cell:
                apart = np.arccos(np.clip(centres[x.cell] @ centres[y.cell], -1, 1)) - x.radius - y.radius
                if low <= 0 or np.cos(max(0.0, apart)) >= low - 1e-9 or x.cell == y.cell:
                    pairs += [(base[x.cell] + i, base[y.cell] + j) for i in range(parts[x.cell]) for j in range(parts[y.cell]) if x.cell < y.cell or i <= j]
    # neighbours share their first block; numbers of blocks, 16 bytes for each pair of them
    at = np.array(sorted(pairs), np.int64)
    spark = vectors.sparkSession
    sizes = spark.createDataFrame([(c, p, base[c]) for c, p in parts.items()], "cell long, parts long, base long")
    blocks = placed.join(F.broadcast(sizes), "cell").select("id", "v", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))  # CENTRES rows
    total = sum(parts.values())
    uri = cut_blocks(blocks, "dense-blocks", total)
    files = block_files(spark, uri)
    kind = rows.schema["id"].dataType

    def block(k: int) -> tuple[pa.Array, np.ndarray] | None:
        if k not in files:
            return None
        table = pa.concat_tables(open_blocks(uri, files[k], pq.read_table)).combine_chunks()
        v = table["v"].combine_chunks()
        return table["id"].combine_chunks(), v.flatten().to_numpy().reshape(len(v), -1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)
        for batch in batches:
            for p, q in at[batch.column(0).to_numpy()].tolist():
                held = held if held[0] == p else (p, block(p))
                x, y = held[1], held[1] if p == q else block(q)
                if x is None or y is None:
                    continue
                dots = x[1] @ y[1].T
                i, j = np.nonzero((dots >= low) & (dots <= high))
                if p == q:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 1 << 16):
                    u, w = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([x[0].take(pa.array(u)), y[0].take(pa.array(w)), pa.array(dots[u, w])], names=["a", "b", "cosine"])

    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("cosine", DoubleType())])
    met = spark.range(0, len(at), 1, min(len(at), max(4 * total, len(at) // 64))).mapInArrow(multiply, schema).filter("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def anti_duplicate(pairs: DataFrame, texts: DataFrame, node: str, text: str, most: float = 0.8) -> DataFrame:
    """pairs (a, b) with the Jaccard similarity of their texts' lower-cased tokens, those below `most` only."""
    words = texts.select(F.col(node), F.array_distinct(tokens(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("w"))
    one = lambda s: words.select(F.col(node).alias(s), F.col("w").alias(f"w_{s}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").withColumn("jaccard", jaccard(F.col("w_a"), F.col("w_b")))
    return both.filter(F.col("jaccard") < most).select(*pairs.columns, "jaccard")


# ---- phrases ----


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity of matching and transposed characters, raised by a common prefix of up to 4 (Winkler 1990)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, own = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                own.append(x)
                break
    m = len(own)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if taken[j]]
    t = sum(x != y for x, y in zip(own, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def _similarities(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in parts:
        yield pa.array([jaro_winkler(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def similar_phrases(phrases: DataFrame, phrase: str, least: float = 0.9) -> DataFrame:
    """x, y of distinct phrases (both orders, and each with itself) whose Jaro-Winkler similarity is at least `least`.

    Candidates share characters: with similarity s, Jaro's is at least (s - 0.4) / 0.6 = j, and the shared characters m
    satisfy m / |x| + m / |y| >= 3 j - 1, so m >= (3 j - 2) |x| of both. That is a prefix filter on characters numbered
    by their repetition. All candidates are verified.
    """
    every = phrases.select(F.col(phrase).alias("x")).distinct()
    j = (least - 0.4) / 0.6
    if j <= 2 / 3:
        raise ValueError("similarities of at most 0.8 can't be found by shared characters")
    chars = every.select("x", F.posexplode(F.filter(F.split("x", ""), lambda c: c != "")).alias("at", "c"))
    nth = F.row_number().over(Window.partitionBy("x", "c").orderBy("at"))
    marked = chars.withColumn("token", F.concat("c", nth.cast("string"))).select("x", "token")
    freq = marked.groupBy("token").agg(F.count("*").alias("f"))
    own = Window.partitionBy("x")
    ranked = marked.join(freq, "token").withColumn("n", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("f", "token")))
    prefix = cut(ranked.filter(F.col("place") <= F.col("n") - F.ceil((3 * j - 2) * F.col("n") - 1e-9) + 1).select("x", "token", "n", "place"), "phrase-prefix")
    other = prefix.select("token", F.col("x").alias("y"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    near = prefix.join(other, "token").filter((F.col("x") < F.col("y")) & (most / F.col("n") + most / F.col("n2") >= 3 * j - 1 - 1e-9)).select("x", "y").distinct()
    found = cut(near.withColumn("s", F.arrow_udf(_similarities, "double")("x", "y")).filter(F.col("s") >= least), "phrase-pairs")
    return found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y"), "s")).unionByName(every.select("x", F.col("x").alias("y"), F.lit(1.0).alias("s")))


def keyphrase_overlap_join(chunks: DataFrame, node: str, phrases: str, score: float = 0.02, similarity: float = 0.9, exact: bool = False, items: bool = True) -> DataFrame:
    """a < b, n_matches, score and overlapped_items: pairs of chunks by their similar keyphrases.

    Keyphrases are compared lower-cased; score is the number of matching pairs of keyphrases over the product of both
    numbers of keyphrases. exact counts only equal ones. Repeated phrases of a chunk count once,
    and rows of one node are one chunk. Without items there are no overlapped_items. Exact pairs of common phrases are
    counted block by block.
    """
    sets = chunks.groupBy(F.col(node).alias("d")).agg(F.array_distinct(F.flatten(F.collect_list(F.transform(phrases, F.lower)))).alias("p")).filter(F.size("p") > 0)
    rows = cut(sets.select("d", F.size("p").alias("n"), F.explode("p").alias("x")), "keyphrases")
    left = rows.select(F.col("d").alias("a"), F.col("n").alias("na"), "x")
    right = rows.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("x").alias("y"))
    if exact and not joinable(rows.groupBy("x").agg(F.count("*").alias("f")), rows.count()):
        found = products(rows.select("d", F.col("x").alias("t"), F.lit(1.0).alias("weight"), "n"), lambda k, x, y: k / (x * y) >= score)
        one = lambda s: sets.select(F.col("d").alias(s), F.col("p").alias(f"p_{s}"))
        pairs = found.select("a", "b", F.col("k").cast("long").alias("n_matches"), (F.col("k") / (F.col("n_a") * F.col("n_b"))).alias("score"))
        if not items:
            return pairs
        overlapped = F.transform(F.array_sort(F.array_intersect("p_a", "p_b")), lambda x: F.struct(x.alias("x"), x.alias("y")))
        return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "n_matches", "score", overlapped.alias("overlapped_items"))
    if exact:
        met = left.join(right, F.col("x") == F.col("y"))
    else:
        met = left.join(similar_phrases(rows, "x", similarity).drop("s"), "x").join(right, "y")
    pairs = met.filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_list(F.struct("x", "y"))).alias("overlapped_items"))
    out = pairs.withColumn("score", F.col("n_matches") / (F.col("na") * F.col("nb")))
    return out.filter(F.col("score") >= score).select("a", "b", "n_matches", "score", *(["overlapped_items"] if items else []))


def fuzzy_pairs(left: Column, right: Column, least: float = 0.6) -> Column:
    """x, y and canonical (the shorter, of equals x) of the phrases of two arrays that match, greedily and one to one.

    A phrase of left takes the first free one of right that equals it or whose tokens have a Jaccard similarity of
    `least` or more. Both arrays are the keyphrases of one chunk, so the fold is short.
    """
    words = lambda p: F.filter(F.split(F.lower(p), r"[\s\-_]+"), lambda t: t != "")
    fits = lambda x, y: (x == y) | (jaccard(words(x), words(y)) >= least)
    pair = "struct<x:string,y:string,canonical:string>"
    start = F.struct(right.alias("free"), F.array().cast(f"array<{pair}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.array_min(F.transform(acc["free"], lambda y, i: F.when(fits(x, y), i)))

        def taken(i: Column) -> Column:
            y = F.get(acc["free"], i)
            one = F.array(F.struct(x.alias("x"), y.alias("y"), F.when(F.length(y) < F.length(x), y).otherwise(x).alias("canonical")))
            free = F.filter(acc["free"], lambda z, j: j != i)
            return F.when(i.isNull(), acc).otherwise(F.struct(free.alias("free"), F.concat(acc["out"], one).alias("out")))

        return F.transform(F.array(hit), taken)[0]

    return F.aggregate(left, start, step, lambda acc: acc["out"])
