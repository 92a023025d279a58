"""Structure of Markdown: extraction, sections, chunks. Column functions that stay within a row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.arrays import bind, blocks, running_sum
from weftgraph.functions.text import fix_heading_levels, remove_repeated_lines, strip, token_count, tokens

# What counts as each kind of entity.
ENTITIES = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "URL": r"https?://[^\s)]+",
    "CODE": r"`[^`]+`",
    "VERSION": r"\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b",
    "METRIC": r"[0-9]+(?:\.[0-9]+)?(?:%|€|\$|ms|kg|km|GB|MB)",
    "FILE_PATH": r"(?:/[A-Za-z0-9_.-]+){2,}",
}


def headings(text: Column) -> Column:
    pattern = F.lit(r"(?m)^(#{1,6})[ \t]+([^\n]+)$")
    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.struct(F.length(a).alias("level"), b.alias("title")))


def links(text: Column) -> Column:
    pattern = F.lit(r"\[([^\]]+)\]\(([^)]+)\)")
    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.struct(a.alias("text"), b.alias("url")))


def code_blocks(text: Column) -> Column:
    pattern = F.lit(r"(?s)```([A-Za-z0-9_]+)?\n(.*?)```")
    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.struct(F.coalesce(F.nullif(a, F.lit("")), F.lit("text")).alias("language"), F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")).alias("code")))


def inline_code(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1))


def entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    parts = [F.transform(F.regexp_extract_all(text_col, F.lit(p), F.lit(0)), _typed(k)) for k, p in ENTITIES.items()]
    return df.select(id_col, F.explode(F.concat(*parts)).alias("e")).select(id_col, "e.*")


def _typed(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def feature_counts(text: Column) -> dict[str, Column]:
    """has_code, code_block_count, inline_code_count and table_count of a document."""
    blocks = F.size(code_blocks(text))
    return {
        "has_code": blocks > 0,
        "code_block_count": blocks,
        "inline_code_count": F.size(inline_code(text)),
        "table_count": F.coalesce(F.array_max(F.transform(tables(text), lambda t: t["table_no"])), F.lit(0)).cast("int"),
    }


# ---- lines; every operator works within a row, and running sums stand for windows ----


def marked_lines(text: Column) -> Column:
    """line and in_fence (parity of the fence lines before) of every line."""

    def marked(own: Column) -> Column:
        fences = running_sum(F.transform(own, lambda x: strip(x).startswith("```").cast("bigint")))
        return bind(fences, lambda f: F.transform(own, lambda x, i: F.struct(x.alias("line"), (F.get(f, i) % 2 == 1).alias("in_fence"))))

    return bind(F.split(text, "\n", -1), marked)


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ord (from 0), line, in_fence."""
    rows = df.select(id_col, F.posexplode(marked_lines(F.col(text_col))).alias("ord", "l"))
    return rows.select(id_col, "ord", "l.line", "l.in_fence")


def tables(text: Column) -> Column:
    """table_no, ord and cells of the rows of consecutive |…| lines; separators are skipped, not breaks."""

    def found(own: Column) -> Column:
        is_row = lambda x: F.coalesce(strip(x).startswith("|") & strip(x).endswith("|") & (F.length(strip(x)) > 1), F.lit(False))
        fresh = F.transform(own, lambda x, i: (is_row(x) & ~((i > 0) & is_row(F.coalesce(F.get(own, i - 1), F.lit(""))))).cast("bigint"))

        def numbered(before: Column, flags: Column) -> Column:
            rows = F.transform(own, lambda x, i: F.struct((F.get(before, i) + F.get(flags, i)).alias("table_no"), i.alias("ord"), strip(x).alias("bare"), is_row(x).alias("is_row")))
            kept = F.filter(rows, lambda r: r["is_row"] & ~r["bare"].rlike(r"^\|[\s:|-]+\|$"))
            cells = lambda bare: F.transform(F.split(F.substr(bare, F.lit(2), F.length(bare) - 2), r"\|"), strip)
            return F.transform(kept, lambda r: F.struct(r["table_no"].alias("table_no"), r["ord"].alias("ord"), cells(r["bare"]).alias("cells")))

        return bind(fresh, lambda f: bind(running_sum(f), lambda b: numbered(b, f)))

    return bind(F.split(text, "\n", -1), found)


def table_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.explode(tables(F.col(text_col))).alias("t")).select(id_col, "t.*")


SECTION = "struct<section:bigint,level:int,title:string,breadcrumb:string,content:string>"


def section_array(text: Column) -> Column:
    """section (number of the heading), level, title, breadcrumb and content of every section that isn't blank."""

    def heads_of(own: Column) -> Column:
        found = F.filter(F.transform(own, lambda x, i: F.when(x["line"].startswith("#") & ~x["in_fence"], i)), lambda i: i.isNotNull())
        level = lambda x: F.length(F.regexp_extract(x["line"], "^#+", 0))
        head = lambda i: F.struct(i.alias("at"), level(F.get(own, i)).alias("level"), strip(F.regexp_replace(F.get(own, i)["line"], "^#+", "")).alias("title"))
        before = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("level"), F.lit("Introduction").alias("title")))
        return F.concat(before, F.transform(found, head))

    stack_type, out_type = "array<struct<level:int,title:string>>", "array<string>"

    def step(acc: Column, x: Column) -> Column:
        # what is at the same level or deeper is closed; the text before the first heading is no part of any path
        stack = F.concat(F.filter(acc["stack"], lambda y: y["level"] < x["level"]), F.filter(F.array(F.struct(x["level"].alias("level"), x["title"].alias("title"))), lambda y: y["level"] > 0))
        path = F.when(x["level"] == 0, x["title"]).otherwise(F.array_join(F.transform(stack, lambda y: y["title"]), " > "))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(path)).alias("out"))

    def paths(heads: Column) -> Column:
        none = lambda t: F.array().cast(t)
        start = F.struct(none(stack_type).alias("stack"), F.array().cast("array<array<string>>").alias("outs"))

        def over(acc: Column, part: Column) -> Column:
            inner = F.aggregate(part, F.struct(acc["stack"].alias("stack"), none(out_type).alias("out")), step)
            return bind(inner, lambda r: F.struct(r["stack"].alias("stack"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

        return F.aggregate(blocks(heads), start, over, lambda acc: F.flatten(acc["outs"]))

    def sections_of(own: Column, heads: Column, path: Column) -> Column:
        def one(h: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1)["at"], F.size(own))
            body = F.transform(F.slice(own, h["at"] + 2, end - h["at"] - 1), lambda x: x["line"])
            return F.struct(k.cast("bigint").alias("section"), h["level"].alias("level"), h["title"].alias("title"), F.get(path, k).alias("breadcrumb"), F.array_join(body, "\n").alias("content"))

        return F.filter(F.transform(heads, one), lambda x: x["content"].rlike(r"[^\s\p{Z}]"))

    return bind(marked_lines(text), lambda own: bind(heads_of(own), lambda heads: bind(paths(heads), lambda path: sections_of(own, heads, path))))


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, section, level, title, breadcrumb, content."""
    return df.select(id_col, F.explode(section_array(F.col(text_col))).alias("s")).select(id_col, "s.*")


def merged_array(secs: Column, max_tokens: int) -> Column:
    """Greedy packing of consecutive sections while their tokens fit: level, title and breadcrumb of the first, all titles.

    The fold goes over token counts only and keeps where a pack begins; texts are joined once afterwards.
    """
    part = "struct<begin:int,size:int,n:int>"

    def packs(counts: Column) -> Column:
        def step(acc: Column, n: Column) -> Column:
            last = F.element_at(acc["out"], -1)
            fits = (F.size(acc["out"]) > 0) & (F.get(acc["out"], F.size(acc["out"]) - 1)["n"] + n <= max_tokens)
            grown = F.struct(last["begin"].alias("begin"), (last["size"] + 1).alias("size"), (last["n"] + n).alias("n"))
            fresh = F.struct(acc["i"].alias("begin"), F.lit(1).alias("size"), n.alias("n"))
            out = F.when(fits, F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(grown))).otherwise(F.concat(acc["out"], F.array(fresh)))
            return F.struct((acc["i"] + 1).alias("i"), out.alias("out"))

        return F.aggregate(counts, F.struct(F.lit(0).alias("i"), F.array().cast(f"array<{part}>").alias("out")), step, lambda acc: acc["out"])

    def joined(own: Column) -> Column:
        counts = F.transform(own, lambda x: token_count(x["content"]))

        def one(p: Column) -> Column:
            first, rows = F.get(own, p["begin"]), F.slice(own, p["begin"] + 1, p["size"])
            text = F.array_join(F.transform(rows, lambda x: x["content"]), "\n\n")
            return F.struct(first["level"].alias("level"), first["title"].alias("title"), first["breadcrumb"].alias("breadcrumb"), text.alias("content"), p["n"].alias("token_count"), F.transform(rows, lambda x: x["title"]).alias("merged_titles"))

        return F.transform(bind(counts, packs), one)

    return bind(secs, joined)


def pieces(text: Column, max_tokens: int, overlap_ratio: float = 0.1) -> Column:
    """content and token_count of windows of max_tokens with the given overlap; one element per window, no token array beside."""
    stride = max(1, max_tokens - int(max_tokens * overlap_ratio))

    def windows(w: Column) -> Column:
        cut = lambda b: F.slice(w, b + 1, F.lit(max_tokens))
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(stride)), lambda b: F.struct(F.array_join(cut(b), " ").alias("content"), F.least(F.size(w) - b, F.lit(max_tokens)).alias("token_count")))
        return F.filter(every, lambda x: x["token_count"] > 0)

    return bind(tokens(text), windows)


def merge_small(df: DataFrame, id_col: str, text_col: str, max_tokens: int) -> DataFrame:
    """id, chunk_index, level, title, breadcrumb, content, token_count, merged_titles of a document's packed sections."""
    packed = merged_array(section_array(F.col(text_col)), max_tokens)
    return df.select(id_col, F.posexplode(packed).alias("chunk_index", "m")).select(id_col, "chunk_index", "m.*")


def chunks(df: DataFrame, id_col: str, text_col: str, max_tokens: int = 1024, overlap_ratio: float = 0.1, min_tokens: int = 50) -> DataFrame:
    """The chunks of documents: sections, packed, the long ones split, the short ones dropped after they have their index."""
    packed = merged_array(section_array(F.col(text_col)), max_tokens)

    def split(m: Column) -> Column:
        one = lambda text, n, sub: F.struct(m["level"].alias("section_level"), m["title"].alias("section_title"), m["breadcrumb"].alias("breadcrumb"), text.alias("content"), n.alias("token_count"), F.lit(sub).alias("is_subdivision"), m["merged_titles"].alias("merged_titles"))
        parts = F.transform(pieces(m["content"], max_tokens, overlap_ratio), lambda p: one(p["content"], p["token_count"], True))
        return F.when(m["token_count"] > max_tokens, parts).otherwise(F.array(one(m["content"], m["token_count"], False)))

    rows = df.select(id_col, F.posexplode(F.flatten(F.transform(packed, split))).alias("chunk_index", "c"))
    return rows.select(id_col, "chunk_index", "c.*").filter(F.col("token_count") >= min_tokens)


def split_long(df: DataFrame, id_col: str, text_col: str, max_tokens: int, overlap_ratio: float = 0.1) -> DataFrame:
    """Windows of max_tokens with the given overlap: id, piece, content, token_count."""
    return df.select(id_col, F.posexplode(pieces(F.col(text_col), max_tokens, overlap_ratio)).alias("piece", "p")).select(id_col, "piece", "p.*")


def drop_repeated_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_removed and text without the lines that remove_repeated_lines takes."""
    kept = remove_repeated_lines(F.col(text_col))
    rows = df.select(id_col, F.col(text_col).alias("_before"), kept.alias("text"))
    n = lambda c: F.regexp_count(c, F.lit("\n"))
    # every line but the last ends with a line break; a text whose lines all go is left empty
    gone = F.when(F.col("text") == F.col("_before"), 0).otherwise(F.size(F.split("_before", "\n", -1)) - F.when(F.col("text") == "", 0).otherwise(n("text") + 1))
    return rows.select(id_col, gone.cast("bigint").alias("n_removed"), "text")


def fix_headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, fix_heading_levels(F.col(text_col)).alias("text"))
