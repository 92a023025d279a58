"""Near-duplicates by fast similarity sketches, banding and exact verification.

The sketch (Dahlgaard, Knudsen and Thorup 2017) throws every shingle into one of SIZE bins in each
round, keeping a bin's first and smallest value; as many further rounds fill one bin each, so that
every coordinate gets a value, and coordinates concentrate like independent ones. SIZE / ROWS bands
of ROWS coordinates make candidates: at the similarity of 0.8 a pair shares none of 32 bands with a
chance below 5e-8.

Texts with equal sets are one class from the start: equal in number and in the sums of two independent 64-bit
hashes over all shingles. Classes that share a band are linked in two steps, both confirmed on full sets of
64-bit hashes (two sets of 100,000 shingles have a collision between them with a chance below 1e-9; the hash
is not linear, so no structure of texts makes one). First each class is compared with the pivot of each of its
buckets, the most central member. After the components of those links are known, pairs of different components
are formed where two members of a pivot's buckets share enough of their differences from that pivot: a prefix
and a positional filter (Chaudhuri et al. 2006, Xiao et al. 2008) on differences, in which what a large group
has in common does not appear. The filters are exact and all pairs that pass are verified, so no link between
candidates is lost, while pairs within a component are never formed.

Only the texts of classes in shared buckets are read again. They are picked by a bitmap of their ids of at most
common.BITMAP_BITS bits, whatever the corpus; ids that only share a bit go in the join behind it.

Defined cases: null, empty or blank texts have the empty set and are linked with nothing; a row with a null
doc_id is its own component, null; rows with equal doc_id are one node of the graph, each its own row of the
result, and kept alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import among, apart, bounded_batches, cut, discard, marked, tidy, two_columns
from weftgraph.llm.components import components
from weftgraph.llm.textbytes import SPACE, Spans, column_bytes, mix, runs, slices

SIZE, ROWS = 128, 4
_EMPTY = np.uint64((1 << 64) - 1)
_LOW = np.uint64((1 << 48) - 1)
_SEEDS = np.random.default_rng(3).integers(1, 1 << 63, 2 * SIZE, dtype=np.uint64)
_STEP = np.random.default_rng(4).integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Sorted distinct shingle hashes of each row, and the sums of two hashes of them; A-Z count as a-z."""
    begin, end = runs(~SPACE[data], at)
    w = Spans(data).of(begin, end)
    cut_at = np.searchsorted(begin, at)
    # a chain over the words of every shingle: one permutation per word, so that order counts
    one, two = (np.full(max(0, len(w) - words + 1), step, np.uint64) for step in _STEP)
    for k in range(words):
        one = mix(one ^ w[k : k + len(one)]) + _STEP[0]
        two = mix(two + w[k : k + len(two)]) ^ _STEP[1]
    sets, keys = [], []
    for a, b in zip(cut_at[:-1], cut_at[1:], strict=True):
        if b - a >= words:
            own, first = np.unique(one[a : b - words + 1], return_index=True)
            second = two[a : b - words + 1][first]
        elif b > a:
            own, second = _STEP[:1] + np.uint64(b - a), _STEP[1:] + np.uint64(b - a)
            for k in range(a, b):
                own, second = mix(own ^ w[k : k + 1]) + _STEP[0], mix(second + w[k : k + 1]) ^ _STEP[1]
        else:
            own = second = np.zeros(0, np.uint64)
        sets.append(own)
        keys.append((int(own.sum(dtype=np.uint64).astype(np.int64)), int(second.sum(dtype=np.uint64).astype(np.int64))))
    return sets, keys


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SIZE coordinates of 16 bits per set (of an empty set: zeros)."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    best = np.full(n * SIZE, _EMPTY, np.uint64)
    x, row = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(n), sizes)
    for r in range(2 * SIZE):
        if not len(x):
            break
        h = mix(x ^ _SEEDS[r])
        bins = (h >> np.uint64(57)).astype(np.int64) if r < SIZE else r - SIZE
        np.minimum.at(best, row * SIZE + bins, np.uint64(r << 48) | h & _LOW)
        left = (best.reshape(n, SIZE) == _EMPTY).any(axis=1)[row]
        x, row = x[left], row[left]
    return (mix(best) & np.uint64(0xFFFF)).astype(np.uint16).reshape(n, SIZE)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _hashed(words: int, with_sketch: bool):
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            data, at = column_bytes(col)
            sizes, keys, arrays = [], [], []
            for lo, hi in slices(at):
                sets, both = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words)
                sizes += [len(s) for s in sets]
                keys += both
                if with_sketch:
                    for k in range(0, len(sets), 512):
                        arrays += list(sketches(sets[k : k + 512]).view(np.int64))
                else:
                    arrays += [np.sort(s.view(np.int64)) for s in sets]
            numbers = [pa.array(x, pa.int64()) for x in (sizes, [k for k, _ in keys], [k for _, k in keys])]
            yield pa.StructArray.from_arrays([*numbers, _lists(arrays)], ["n", "key1", "key2", "sketch" if with_sketch else "members"])

    return F.arrow_udf(run, f"n long, key1 long, key2 long, {'sketch' if with_sketch else 'members'} array<long>").asNondeterministic()


def _split(col: pa.Array) -> list[np.ndarray]:
    flat, ends = col.flatten().to_numpy(), col.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]


@tidy
def _differences(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The shingles of exactly one of two sets."""
    for left, right in pairs:
        out = []
        for a, b in zip(_split(left), _split(right), strict=True):
            both = np.sort(np.concatenate([a, b]))
            twice = both[1:] == both[:-1]
            out.append(both[~(np.append(twice, False) | np.append(False, twice)[: len(both)])])
        yield _lists(out)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with diff, the shingles of exactly one of the sets of a and b, and the documents that stand for both."""
    sets = among(sets, pairs.select(F.explode(F.array("a", "b")).alias("rep")), "rep")
    one = lambda s: sets.select(F.col("rep").alias(s), F.col("doc").alias(f"doc_{s}"), F.col("members").alias(f"set_{s}"))
    both = pairs.join(one("a").hint("merge"), "a").join(one("b").hint("merge"), "b")
    return both.select(*pairs.columns, "doc_a", "doc_b", F.arrow_udf(_differences, "array<long>")("set_a", "set_b").alias("diff"))


def _reaches(differ: Column, sizes: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, from the number of differences and the sum of both sizes."""
    return (100 + percent) * differ <= (100 - percent) * sizes


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    bounded_batches(df.sparkSession)
    docs = two_columns(df, id_col, text_col)
    base = cut(docs.select("doc_id", F.xxhash64("text").alias("print"), _hashed(words, True)("text").alias("s")).select("doc_id", "print", "s.*"), "mh-sketch")
    key = ["n", "key1", "key2"]
    # a class is known by a number of its own: rows with one doc_id can have texts of different classes
    classes = base.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "print")).alias("own"), F.first("sketch").alias("sketch"))
    classes = classes.select(*key, F.col("own.doc_id").alias("doc"), F.col("own.print").alias("print"), "sketch", F.monotonically_increasing_id().alias("rep"))
    classes = cut(classes, "mh-classes")
    members = _members(classes)
    sets = cut(_full_sets(docs, classes, members, words), "mh-sets")
    # documents with several sets: each of their classes is linked with them
    several = base.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).filter("lo <> hi").select("doc_id")
    mixed = cut(base.drop("sketch").join(several, "doc_id").join(classes.select(*key, "doc"), key).select("doc_id", "doc").distinct(), "mh-mixed")
    same = mixed.filter("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    around = cut(_around_pivots(sets), "mh-around")
    links = cut(_links(around, percent).unionByName(same), "mh-links")
    first = components(links)
    more = _remaining_links(around, sets, first, percent)
    labels = components(links.unionByName(more))
    discard(members, sets, around, links, more, first)
    reps = cut(classes.select(*key, "doc").join(labels, F.col("doc") == F.col("node"), "left").select(*key, F.coalesce("component", "doc").alias("component")), "mh-reps")
    # an empty text beside others with its doc_id is of their component
    beside = mixed.join(labels, F.col("doc_id") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "doc")).alias("beside"))
    beside = cut(beside, "mh-beside")
    discard(classes, labels, mixed)
    out = base.drop("sketch").join(reps, key, "left").join(beside, "doc_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "beside", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _members(classes: DataFrame) -> DataFrame:
    """Every class with the pivots of its buckets: in a bucket, the class with the most company in all of its own."""
    bands = classes.select("rep", F.posexplode("sketch").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("bucket"))
    bands = cut(bands, "mh-bands")
    full = bands.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1")
    rows = cut(bands.join(apart(full).hint("merge"), "bucket"), "mh-shared")
    discard(bands)
    weight = rows.groupBy("rep").agg(F.sum("held").alias("weight"))
    rows_w = cut(rows.join(weight.hint("merge"), "rep"), "mh-weighted")
    discard(rows)
    best = rows_w.groupBy("bucket").agg(F.max(F.struct("weight", "rep")).alias("p"))
    out = rows_w.join(apart(best).hint("merge"), "bucket").filter("rep <> p.rep").select("rep", F.col("p.rep").alias("pivot"))
    out = cut(out.distinct(), "mh-members")
    discard(rows_w)
    return out


def _full_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """rep, doc, n, pivots (at most one per band), is_pivot and members of every class that shares a bucket."""
    others = members.groupBy("pivot").agg(F.count("*").alias("others"))
    with_others = members.join(apart(others), "pivot").select("rep", F.struct("pivot", "others").alias("p"))
    roles = with_others.unionByName(others.select(F.col("pivot").alias("rep"), F.lit(None).cast("struct<pivot:bigint,others:bigint>").alias("p")))
    roles = roles.groupBy("rep").agg(F.collect_list("p").alias("pivots"), F.bool_or(F.col("p").isNull()).alias("is_pivot"))
    wanted = cut(classes.join(roles, "rep").select("rep", "doc", "print", "n", "pivots", "is_pivot"), "mh-wanted")
    some = among(docs, wanted.select(F.col("doc").alias("doc_id")), "doc_id")
    # of rows with one doc_id and different texts the class's own; of equal rows one, before the text becomes a set
    own = (F.col("doc_id") == F.col("doc")) & (F.xxhash64("text") == F.col("print"))
    picked = some.join(wanted.hint("merge"), own).dropDuplicates(["doc_id", "doc", "rep"])
    return picked.select("rep", "doc", "n", "pivots", "is_pivot", _hashed(words, False)("text")["members"].alias("members"))


def _around_pivots(sets: DataFrame) -> DataFrame:
    """Members with their documents and d, the number of their differences from the pivot, and these where a pivot has several members."""
    own = sets.select("rep", "doc", "n", "members", F.explode("pivots").alias("p")).select("rep", "doc", "n", "members", "p.*")
    pivots = sets.filter("is_pivot").select(F.col("rep").alias("pivot"), F.col("doc").alias("pdoc"), F.col("n").alias("pn"), F.col("members").alias("held"))
    both = own.join(pivots.hint("merge"), "pivot")
    both = both.select("rep", "pivot", "doc", "pdoc", "n", "pn", "others", F.arrow_udf(_differences, "array<long>")("members", "held").alias("diff"))
    return both.select("rep", "pivot", "doc", "pdoc", "n", "pn", F.size("diff").cast("long").alias("d"), F.when(F.col("others") > 1, F.col("diff")).alias("diff"))


def _links(around: DataFrame, percent: int) -> DataFrame:
    near = around.filter(_reaches(F.col("d"), F.col("n") + F.col("pn"), percent) & (F.col("doc") != F.col("pdoc")))
    return near.select(F.col("doc").alias("a"), F.col("pdoc").alias("b"))


def _remaining_links(around: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between candidates of different components; of both, the pivot's own links are known."""
    rows = around.filter("diff is not null").join(labels, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc")).drop("node")
    mixed = rows.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("pivot")
    placed = cut(_placed(rows.join(apart(mixed), "pivot"), percent), "mh-placed")
    pairs = cut(_sharing_differences(placed, percent), "mh-pairs")
    found = _compared(pairs, sets).filter(_reaches(F.size("diff"), F.col("na") + F.col("nb"), percent))
    out = cut(found.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")), "mh-more")
    discard(placed, pairs)
    return out


def _placed(rows: DataFrame, percent: int) -> DataFrame:
    """The differences of each member from its pivot that may be the first one that it shares with another member.

    Both sets of a pair differ where exactly one of them differs from the pivot, so the pair reaches the similarity
    if it shares at least (e + e') / (2 * (100 + percent)) differences, e = (100 + percent) * d - (100 - percent) * n.
    A member is linked with the pivot if e <= (100 - percent) * pn; two linked ones are in one component. So one of the
    pair is not, and e' > (100 - percent) * pn of it; of any set e' >= -(100 - percent) * pn. They share at most d'
    differences too, so at least (e - (100 - percent) * n') / (100 + percent), and n' is at most 100 * n / percent.
    Differences are ordered rarest first; those that no pair of different components can share take the first places but make no rows.
    """
    excess = (100 + percent) * F.col("d") - (100 - percent) * F.col("n")
    bound = (100 - percent) * F.col("pn")
    rows = rows.withColumn("e", excess).withColumn("near", F.col("e") <= bound)
    held = cut(rows.select("pivot", "rep", "n", "pn", "d", "e", "near", "component", F.explode("diff").alias("shingle")), "mh-held")
    useful = held.groupBy("pivot", "shingle").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("near").alias("all_near"))
    useful = useful.filter("lo <> hi and not all_near").select("pivot", "shingle", "f")
    own = Window.partitionBy("pivot", "rep")
    placed = held.join(apart(useful), ["pivot", "shingle"]).withColumn("place", F.row_number().over(own.orderBy("f", "shingle")))
    placed = placed.withColumn("place", F.col("d") - F.count("*").over(own) + F.col("place"))
    most = F.col("d") - F.col("place") + 1
    least = F.col("e") + F.when(F.col("near"), bound + 1).otherwise(-bound)
    enough = (2 * (100 + percent) * most >= least) & ((100 + percent) * most >= F.col("e") - (100 - percent) * F.floor(100 * F.col("n") / percent))
    return placed.filter(enough).select("pivot", "shingle", "rep", "n", "component", "d", "e", "near", "place")


def _sharing_differences(placed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of different components that can share enough differences from a pivot.

    When the first one shared, rarest first, is at place i of d and j of d', at most 1 + min(d - i, d' - j) are shared.
    """
    left = placed.filter("not near").drop("near")
    right = placed.select("pivot", "shingle", "near", *[F.col(c).alias(f"{c}_2") for c in ("rep", "n", "component", "d", "e", "place")])
    most = 1 + F.least(F.col("d") - F.col("place"), F.col("d_2") - F.col("place_2"))
    fits = 2 * (100 + percent) * most >= F.col("e") + F.col("e_2")
    for e, n in (("e", "n_2"), ("e_2", "n")):
        fits &= (100 + percent) * most >= F.col(e) - (100 - percent) * F.col(n)
    once = F.col("near") | (F.col("rep") < F.col("rep_2"))
    pairs = left.join(right, ["pivot", "shingle"]).filter(once & (F.col("component") != F.col("component_2")) & fits)
    first = F.col("rep") < F.col("rep_2")
    return pairs.select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b"), F.when(first, F.col("n")).otherwise(F.col("n_2")).alias("na"), F.when(first, F.col("n_2")).otherwise(F.col("n")).alias("nb")).distinct()


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """df's rows and columns, of each group the document with the smallest id."""
    gone = near_groups(df, id_col, text_col, **limits).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_mh_id")).distinct()
    gone = cut(gone, "mh-gone")
    # df's columns travel in one struct, so that none of their names can clash
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("key"))
    # what the bitmap does not know stays where it is; only the rest is shuffled to be decided
    maybe = marked(rows, gone.select(F.col("_mh_id").alias("key")), "key")
    decided = maybe.filter("_maybe and key is not null").join(gone.hint("merge"), F.col("key") == F.col("_mh_id"), "left_anti")
    return maybe.filter("not _maybe or key is null").unionByName(decided).select("row.*")
