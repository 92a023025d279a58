"""Queries of the graph's own operators over the driver's tables, each with its SQL.

The documents hold no Markdown, so it is made from them by the same expression on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import graph as G
from weftgraph.operators import enrich as E
from weftgraph.operators import markdown as M
from weftgraph.operators import qa as Q
from weftgraph.operators import scenario as S
from weftgraph.operators import similarity as X
from weftgraph.plans.catalog import register
from weftgraph.storage import cut

#: Markdown from a document; valid in both dialects.
MD = (
    "'# Doc ' || doc_id || chr(10) || 'Page 3 of 9' || chr(10) || '## 1.2 Part ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '```py' || chr(10) || '# no heading' || chr(10)"
    " || 'x = ' || doc_id || chr(10) || '```' || chr(10) || '### Deep ' || source || chr(10) || 'see [link ' || doc_id || '](http://x.org/' || doc_id || ') and `code' || doc_id || '`' || chr(10) || '- 7 -' || chr(10)"
    " || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |' || chr(10) || '## Empty' || chr(10) || '## References' || chr(10) || 'tail v1.2 12.5%'"
)
MD_SQL = f"md AS (SELECT doc_id, source, lang, {MD} AS md FROM documents)"
WORDS = r"'[^\s\p{Z}]+'"
LINES_SQL = "l AS (SELECT doc_id, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS ord, unnest(string_split(md, chr(10))) AS line FROM md)"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _md(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "source", "lang", F.expr(MD).alias("md"))


def _digest(text):
    return F.md5(F.encode(text, "UTF-8"))


def query(name: str, sql: str | None = None):
    def keep(run):
        register(name, run, sql)
        return run

    return keep


# ---- cleaning ----


@query("clean_unicode", f"WITH {MD_SQL} SELECT doc_id, md5(regexp_replace(replace(replace(replace('ﬁ' || chr(173) || md || chr(160) || 'co-' || chr(10) || 'op', 'ﬁ', 'fi'), chr(173), ''), chr(160), ' '), '([\\p{{L}}\\p{{N}}_])-\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')) AS digest FROM md")
def _(s, d):
    odd = F.concat(F.lit("ﬁ­"), "md", F.lit(" co-\nop"))
    return _md(s, d).select("doc_id", _digest(T.repair_unicode(odd)).alias("digest"))


ODD = "'see Page 3 of the big book' || chr(10) || 'Page 3 of 9' || chr(10) || ' - ' || doc_id || ' -' || chr(10) || coalesce(text, '') || chr(10) || doc_id || chr(10) || 'Page 7' || chr(10) || '* note ' || doc_id || chr(10) || '*bold*' || chr(10) || '[w @ us](mailto:a@b.c) [a@b.c](mailto:a@b.c) [me](mailto:x@y.z)' || chr(10) || 'https://x.org/' || doc_id || chr(10) || '[1 https://x.org](https://x.org/' || doc_id || ')' || chr(10) || 'end ' || doc_id"
ODD_SQL = f"o AS (SELECT doc_id, {ODD} AS t FROM documents)"


def _odd(s, d):
    return _t(s, d, "documents").select("doc_id", F.expr(ODD).alias("t"))


@query("clean_page_numbers", f"WITH {ODD_SQL} SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(?mi)^.*\\bPage\\s*\\d+\\s+of\\s+.{{3,100}}$', '', 'g'), '(?mi)^\\s*(?:Page\\s*\\d+(?:\\s+of\\s+.{{0,80}})?|-\\s*\\d+\\s*-|\\d+)\\s*$', '', 'g')) AS digest FROM o")
def _(s, d):
    return _odd(s, d).select("doc_id", _digest(T.strip_page_lines(F.col("t"))).alias("digest"))


@query("strip_footnotes", f"WITH {ODD_SQL} SELECT doc_id, md5(regexp_replace(t, '(?m)^\\s*[*†‡§¹²³⁴⁵⁶⁷⁸⁹⁰]\\s+\\S.{{0,200}}$', '', 'g')) AS digest FROM o")
def _(s, d):
    return _odd(s, d).select("doc_id", _digest(T.strip_footnotes(F.col("t"))).alias("digest"))


@query("technical_links", f"WITH {ODD_SQL}, a AS (SELECT doc_id, regexp_replace(t, '\\[\\s*[^\\s\\]]+@[^\\s\\]]+\\.[^\\s\\]]+\\s*\\]\\(mailto:[^)]+\\)', '', 'g') AS t FROM o), b AS (SELECT doc_id, regexp_replace(t, '\\[\\s*([^\\]]*?)\\s*\\]\\(mailto:[^)]+\\)', '\\1', 'g') AS t FROM a), c AS (SELECT doc_id, regexp_replace(t, '(?m)^\\s*https?://\\S+\\s*$', '', 'g') AS t FROM b) SELECT doc_id, md5(regexp_replace(t, '(?m)^\\s*\\[\\d+\\s+https?://\\S*\\]\\(https?://[^)]*\\)\\s*$', '', 'g')) AS digest FROM c")
def _(s, d):
    return _odd(s, d).select("doc_id", _digest(T.strip_technical_links(F.col("t"))).alias("digest"))


@query("strip_trailing_sections", f"WITH {MD_SQL} SELECT doc_id, md5(regexp_replace(regexp_extract(md, '(?s)^(.*?)\n## References', 1), '\\s+$', '') || chr(10)) AS digest FROM md")
def _(s, d):
    return _md(s, d).select("doc_id", _digest(T.strip_trailing_sections(F.col("md"))).alias("digest"))


@query("repeated_lines", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT *, trim(line, ' ') AS bare, count(*) OVER (PARTITION BY doc_id, trim(line, ' ')) AS n FROM l), g AS (SELECT *, length(bare) > 5 AND length(bare) < 80 AND NOT starts_with(bare, '#') AND n >= 3 AS goes FROM c) SELECT doc_id, count(*) FILTER (WHERE goes) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT goes), '')) AS digest FROM g GROUP BY doc_id")
def _(s, d):
    return M.drop_repeated_lines(_t(s, d, "documents"), "doc_id", "text").select("doc_id", "n_removed", _digest(F.col("text")).alias("digest"))


@query("ensure_title", "SELECT doc_id, md5(CASE WHEN regexp_matches(text, '(?m)^\\s*#') THEN text ELSE '# ' || replace('d_' || doc_id, '_', ' ') || chr(10) || chr(10) || text END) AS digest FROM documents")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", _digest(T.ensure_title(F.col("text"), F.concat(F.lit("d_"), "doc_id"))).alias("digest"))


SPECIAL_SQL = "regexp_matches(lower(title), '^(abstract|introduction|conclusion|conclusions|references|bibliography|acknowledgments|acknowledgements|appendix|supplementary|related work|background|discussion|limitations|future work|methodology|experiments|results|evaluation)')"


@query("fix_headings", f"WITH {MD_SQL}, m2 AS (SELECT doc_id, '## Background' || chr(10) || md || chr(10) || '## Last ' || doc_id AS md FROM md), l AS (SELECT doc_id, generate_subscripts(string_split(md, chr(10)), 1) AS ord, unnest(string_split(md, chr(10))) AS line FROM m2), t AS (SELECT *, starts_with(line, '## ') AS two, trim(substr(line, 4), ' ') AS title FROM l), n AS (SELECT *, regexp_extract(title, '^(\\d+(?:\\.\\d+)*)\\s+.', 1) AS num FROM t), p AS (SELECT *, two AND num = '' AND NOT {SPECIAL_SQL} AS plain FROM n), k AS (SELECT *, sum(plain::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS nth FROM p) SELECT doc_id, md5(string_agg(CASE WHEN NOT two THEN line ELSE repeat('#', CASE WHEN num <> '' THEN least(4, len(string_split(num, '.')) + 1) WHEN plain AND nth = 1 THEN 1 ELSE 2 END) || ' ' || title END, chr(10) ORDER BY ord)) AS digest FROM k GROUP BY doc_id")
def _(s, d):
    text = F.concat(F.lit("## Background\n"), "md", F.lit("\n## Last "), F.col("doc_id").cast("string"))
    return _md(s, d).select("doc_id", _digest(T.fix_heading_levels(text)).alias("digest"))


@query("html_unescape")
def _(s, d):
    return _t(s, d, "pages").select("page_id", T.html_unescape("html").alias("html"))


@query("clean_markdown")
def _(s, d):
    return _md(s, d).select("doc_id", T.clean_markdown(F.col("md"), F.concat(F.lit("d_"), "doc_id")).alias("text"))


# ---- extraction ----


@query("headings", f"WITH {MD_SQL} SELECT doc_id, CAST(len(regexp_extract_all(md, '(?m)^(#{{1,6}})[ \\t]+([^\\n]+)$')) AS INTEGER) AS n, array_to_string(regexp_extract_all(md, '(?m)^(#{{1,6}})[ \\t]+([^\\n]+)$', 2), '/') AS titles FROM md")
def _(s, d):
    h = M.headings(F.col("md"))
    return _md(s, d).select("doc_id", F.size(h).alias("n"), F.array_join(F.transform(h, lambda x: x["title"]), "/").alias("titles"))


@query("links", f"WITH {MD_SQL} SELECT doc_id, unnest(regexp_extract_all(md, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 1)) AS label, unnest(regexp_extract_all(md, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2)) AS url FROM md")
def _(s, d):
    return _md(s, d).select("doc_id", F.explode(M.links(F.col("md"))).alias("l")).select("doc_id", F.col("l.text").alias("label"), "l.url")


@query("code_blocks", f"WITH {MD_SQL} SELECT doc_id, unnest(regexp_extract_all(md, '(?s)```([A-Za-z0-9_]+)?\\n(.*?)```', 1)) AS language, trim(unnest(regexp_extract_all(md, '(?s)```([A-Za-z0-9_]+)?\\n(.*?)```', 2)), ' ' || chr(10)) AS code FROM md")
def _(s, d):
    return _md(s, d).select("doc_id", F.explode(M.code_blocks(F.col("md"))).alias("c")).select("doc_id", "c.*")


@query("inline_code", f"WITH {MD_SQL} SELECT doc_id, array_to_string(regexp_extract_all(md, '`([^`]+)`', 1), '|') AS code FROM md")
def _(s, d):
    return _md(s, d).select("doc_id", F.array_join(M.inline_code(F.col("md")), "|").alias("code"))


@query("tables_rows", f"WITH {MD_SQL}, m2 AS (SELECT doc_id, md || chr(10) || '|x|' || doc_id || '|' || chr(10) || '| y |' AS md FROM md), l AS (SELECT doc_id, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS ord, trim(unnest(string_split(md, chr(10))), ' ') AS line FROM m2), r AS (SELECT *, starts_with(line, '|') AND ends_with(line, '|') AND length(line) > 1 AS is_row FROM l), f AS (SELECT *, is_row AND NOT coalesce(lag(is_row) OVER (PARTITION BY doc_id ORDER BY ord), false) AS fresh FROM r), n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS no FROM f) SELECT doc_id, CAST(no AS BIGINT) AS table_no, array_to_string(list_transform(string_split(substr(line, 2, length(line) - 2), '|'), lambda c: trim(c, ' ')), '/') AS cells FROM n WHERE is_row AND NOT regexp_matches(line, '^\\|[\\s:|-]+\\|$')")
def _(s, d):
    md = _md(s, d).select("doc_id", F.concat("md", F.lit("\n|x|"), F.col("doc_id").cast("string"), F.lit("|\n| y |")).alias("md"))
    return M.table_rows(md, "doc_id", "md").select("doc_id", "table_no", F.array_join("cells", "/").alias("cells"))


def _entity_sql() -> str:
    parts = [f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(md, '{p}')) AS value FROM md" for k, p in M.ENTITIES.items()]
    return f"WITH {MD_SQL}, e AS ({' UNION ALL '.join(parts)}) SELECT doc_id, kind, count(*) AS n, min(value) AS first_value FROM e GROUP BY doc_id, kind"


@query("entities", _entity_sql())
def _(s, d):
    return M.entities(_md(s, d), "doc_id", "md").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("value").alias("first_value"))


# ---- chunks ----

FENCE_SQL = f"{LINES_SQL}, f AS (SELECT *, coalesce(sum(CASE WHEN starts_with(trim(line, ' '), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM l)"
SECTION_SQL = (
    f"{FENCE_SQL}, h AS (SELECT *, starts_with(line, '#') AND NOT in_fence AS heading FROM f), g AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM h),"
    " s AS (SELECT doc_id, section, max(line) FILTER (WHERE heading) AS head, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT heading), '') AS content FROM g GROUP BY doc_id, section)"
)


@query("fence_state", f"WITH {MD_SQL}, {FENCE_SQL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE in_fence) AS n_fenced FROM f GROUP BY doc_id")
def _(s, d):
    return M.lines(_md(s, d), "doc_id", "md").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("in_fence").alias("n_fenced"))


@query("sections", f"WITH {MD_SQL}, {SECTION_SQL} SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(coalesce(length(regexp_extract(head, '^#+')), 0) AS INTEGER) AS level, coalesce(trim(regexp_replace(head, '^#+', ''), ' '), 'Introduction') AS title, md5(content) AS digest FROM s WHERE trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') <> ''")
def _(s, d):
    return M.sections(_md(s, d), "doc_id", "md").select("doc_id", "section", "level", "title", _digest(F.col("content")).alias("digest"))


@query("breadcrumbs", f"WITH {MD_SQL}, {SECTION_SQL}, v AS (SELECT *, coalesce(length(regexp_extract(head, '^#+')), 0) AS level, trim(regexp_replace(head, '^#+', ''), ' ') AS title FROM s), a AS (SELECT x.doc_id, x.section, y.section AS up, y.title FROM v x JOIN v y ON y.doc_id = x.doc_id AND y.level > 0 AND (y.section = x.section OR (y.section < x.section AND y.level < x.level)) WHERE NOT EXISTS (SELECT 1 FROM v z WHERE z.doc_id = x.doc_id AND z.section > y.section AND z.section <= x.section AND z.level <= y.level)), b AS (SELECT doc_id, section, string_agg(title, ' > ' ORDER BY up) AS path FROM a GROUP BY doc_id, section) SELECT v.doc_id, coalesce(b.path, 'Introduction') AS breadcrumb FROM v LEFT JOIN b ON b.doc_id = v.doc_id AND b.section = v.section WHERE regexp_matches(content, '\\S')")
def _(s, d):
    return M.sections(_md(s, d), "doc_id", "md").select("doc_id", "breadcrumb")


@query("merge_sections")
def _(s, d):
    return M.merge_small(_md(s, d), "doc_id", "md", 256).drop("merged_titles")


SPLIT_SQL = "w AS (SELECT doc_id, regexp_extract_all(text, '[^\\s\\p{Z}]+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, len(w), 231)) AS b FROM w WHERE len(w) > 0), c AS (SELECT doc_id, CAST(b // 231 AS INTEGER) AS piece, w[b + 1:b + 256] AS part FROM p)"


@query("split_long", f"WITH {SPLIT_SQL} SELECT doc_id, piece, CAST(len(part) AS INTEGER) AS token_count, md5(array_to_string(part, ' ')) AS digest FROM c")
def _(s, d):
    return M.split_long(_t(s, d, "documents"), "doc_id", "text", 256).select("doc_id", "piece", "token_count", _digest(F.col("content")).alias("digest"))


@query("min_tokens", f"WITH {SPLIT_SQL} SELECT doc_id, count(*) AS n_chunks, max(piece) AS last_index FROM c WHERE len(part) >= 50 GROUP BY doc_id")
def _(s, d):
    rows = M.split_long(_t(s, d, "documents"), "doc_id", "text", 256).filter("token_count >= 50")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("piece").alias("last_index"))


# ---- keyphrases; a part's name is a short phrase of several words ----

BANNED = ["small", "the", "and", "of"]


@query("post_filter", "WITH p AS (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS x FROM part) SELECT p_partkey, count(*) AS n FROM p WHERE NOT list_contains(['small', 'the', 'and', 'of'], lower(trim(x))) AND NOT list_bool_and(list_transform(string_split_regex(lower(trim(x)), '[\\s_-]+'), lambda t: list_contains(['small', 'the', 'and', 'of'], t))) AND length(trim(x)) >= 3 AND NOT regexp_matches(trim(x), '^[0-9]+$') GROUP BY p_partkey")
def _(s, d):
    kept = G.post_filter(F.array("p_name", "p_brand", "p_type"), BANNED, ["none"])
    return _t(s, d, "part").select("p_partkey", F.size(kept).cast("long").alias("n")).filter("n > 0")


MORPH_SQL = (
    "a AS (SELECT p_partkey, regexp_replace(trim(lower(p_name || 's ' || p_type)), '''s', '', 'g') AS p FROM part),"
    " b AS (SELECT p_partkey, CASE WHEN ends_with(p, 'ies') AND length(p) > 4 THEN left(p, -3) || 'y' WHEN ends_with(p, 'es') AND length(p) > 4 THEN left(p, -2) WHEN ends_with(p, 's') AND NOT ends_with(p, 'ss') AND length(p) > 4 THEN left(p, -1) ELSE p END AS p FROM a),"
    " c AS (SELECT p_partkey, CASE WHEN ends_with(p, 'ing') AND length(p) > 5 THEN left(p, -3) ELSE p END AS p FROM b)"
)


@query("morph_normalize", f"WITH {MORPH_SQL} SELECT p_partkey, CASE WHEN ends_with(p, 'ed') AND length(p) > 4 THEN left(p, -2) ELSE p END AS phrase FROM c")
def _(s, d):
    return _t(s, d, "part").select("p_partkey", T.morph_normalize(F.concat("p_name", F.lit("s "), "p_type")).alias("phrase"))


PART_WORDS = "t AS (SELECT DISTINCT p_partkey AS d, unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS w FROM part)"


def _part_words(s, d):
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ")
    return _t(s, d, "part").select(F.col("p_partkey").alias("d"), F.explode(F.array_distinct(words)).alias("w"))


@query("idf_prune", f"WITH {PART_WORDS}, f AS (SELECT w, count(*) AS df FROM t GROUP BY w), n AS (SELECT count(DISTINCT d) AS n FROM t) SELECT w, df, count(*) AS kept, round(ln(n / df), 6) AS idf FROM t JOIN f USING (w), n WHERE ln(n / df) >= 0.693 GROUP BY w, df, n")
def _(s, d):
    return G.idf_prune(_part_words(s, d), "d", "w").groupBy("w", "df", "idf").agg(F.count("*").alias("kept")).select("w", "df", "kept", F.round("idf", 6).alias("idf"))


@query("kp_index", f"WITH {PART_WORDS} SELECT w, count(DISTINCT d) AS n_docs, min(d) AS first_doc, max(d) AS last_doc FROM t GROUP BY w HAVING count(DISTINCT d) >= 2")
def _(s, d):
    return G.item_registry(_part_words(s, d), "w", "d")


# ---- similarity joins ----

CONV_WORDS = "t AS (SELECT DISTINCT conv_id AS d, unnest(regexp_extract_all(lower(text), '[^\\s\\p{Z}]+')) AS w FROM conversations)"


def _conv_words(s, d):
    return _t(s, d, "conversations").select(F.col("conv_id").alias("d"), F.explode(T.tokens(F.lower("text"))).alias("w"))


@query("jaccard_join", f"WITH {CONV_WORDS}, n AS (SELECT d, count(*) AS n FROM t GROUP BY d), p AS (SELECT a.d AS a, b.d AS b, count(*) AS k FROM t a JOIN t b ON a.w = b.w AND a.d < b.d GROUP BY a.d, b.d) SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM p JOIN n x ON x.d = a JOIN n y ON y.d = b WHERE k / (x.n + y.n - k) >= 0.12")
def _(s, d):
    return X.jaccard_join(_conv_words(s, d), "d", "w", 0.12).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("tfidf_cosine", "WITH t AS (SELECT conv_id AS d, unnest(regexp_extract_all(lower(text), '[^\\s\\p{Z}]+')) AS w FROM conversations), f AS (SELECT d, w, count(*) AS tf FROM t GROUP BY d, w), g AS (SELECT w, count(*) AS df FROM f GROUP BY w), n AS (SELECT count(DISTINCT d) AS n FROM f), x AS (SELECT d, w, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM f JOIN g USING (w), n), y AS (SELECT d, w, v / sqrt(sum(v * v) OVER (PARTITION BY d)) AS v FROM x), c AS (SELECT a.d AS a, b.d AS b, sum(a.v * b.v) AS c FROM y a JOIN y b ON a.w = b.w AND a.d < b.d GROUP BY a.d, b.d) SELECT a, b, round(c, 4) AS cosine FROM c WHERE c BETWEEN 0.2 AND 0.9")
def _(s, d):
    return X.cosine_terms(X.tfidf(_conv_words(s, d), "d", "w"), "d", "w", 0.2, 0.9).select("a", "b", F.round("cosine", 4).alias("cosine"))


# ---- edges; nations, customers, orders and parts stand for nodes ----


@query("edge_keys", "SELECT least(l_orderkey, l_partkey) || '|' || greatest(l_orderkey, l_partkey) || '|' || CASE WHEN l_returnflag = 'A' THEN 'agent_discovered:' || l_linestatus ELSE 'cosine_similarity' END AS key, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    kind = F.when(F.col("l_returnflag") == "A", "agent_discovered").otherwise("cosine_similarity")
    return _t(s, d, "lineitem").groupBy(G.edge_key(F.col("l_orderkey"), F.col("l_partkey"), kind, F.col("l_linestatus")).alias("key")).agg(F.count("*").alias("n"))


@query("validate_edges", "SELECT d.doc_id, coalesce(quality = 1, true) OR (toxic + 0.4) < 0.5 AS keeps FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    verdicts = _t(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_reliable"), (F.col("toxic") + 0.4).alias("confidence"))
    return G.validate_edges(_t(s, d, "documents").select("doc_id"), verdicts, "doc_id").select("doc_id", "keeps")


@query("theme_registry", "SELECT l_partkey AS theme, count(*) AS n_docs, min(o) AS first_doc, max(o) AS last_doc, md5(string_agg(CAST(o AS VARCHAR), ',' ORDER BY o)) AS docs FROM (SELECT DISTINCT l_partkey, l_orderkey AS o FROM lineitem) GROUP BY l_partkey HAVING count(*) >= 2")
def _(s, d):
    parts = E.theme_registry(_t(s, d, "lineitem").withColumnRenamed("l_partkey", "theme"), "theme", "l_orderkey").filter("n_docs >= 2")
    ids = F.array_sort(F.flatten(F.collect_list("doc_ids")))
    whole = parts.groupBy("theme", "n_docs").agg(ids.alias("ids"))
    return whole.select("theme", "n_docs", F.array_min("ids").alias("first_doc"), F.array_max("ids").alias("last_doc"), F.md5(F.encode(F.array_join("ids", ","), "UTF-8")).alias("docs"))


@query("bridge_pairs", "WITH t AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT x.o AS a, y.o AS b, count(*) AS shared FROM t x JOIN t y ON x.p = y.p AND x.s = y.s AND x.o < y.o GROUP BY x.o, y.o")
def _(s, d):
    rows = _t(s, d, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey").alias("theme"))
    return G.shared_pairs(rows, "l_orderkey", "theme")


@query("concept_bridges", f"WITH {PART_WORDS}, n AS (SELECT count(DISTINCT d) AS n FROM t) SELECT w, count(DISTINCT d) AS n_chunks FROM t, n GROUP BY w, n HAVING count(DISTINCT d) BETWEEN 2 AND greatest(2, floor(n * 0.5))")
def _(s, d):
    return G.concept_bridges(_part_words(s, d), "w", "d")


@query("next_chunk", "SELECT * FROM (SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL")
def _(s, d):
    return G.next_chunk(_t(s, d, "conversations"), "conv_id", "turn")


@query("same_document", "SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def _(s, d):
    rows = _t(s, d, "conversations")
    return rows.select("conv_id", F.col("turn").alias("src")).join(rows.select("conv_id", F.col("turn").alias("dst")), "conv_id").filter("src < dst")


@query("kg_stats", "WITH e AS (SELECT CASE l_returnflag WHEN 'A' THEN 'agent_discovered' WHEN 'N' THEN 'contains' ELSE 'llm_triplet' END AS type FROM lineitem), n AS (SELECT 'DOCUMENT' AS type FROM orders UNION ALL SELECT 'CHUNK' FROM part) SELECT 'nodes' AS measure, count(*) AS n FROM n UNION ALL SELECT 'documents', count(*) FROM n WHERE type = 'DOCUMENT' UNION ALL SELECT 'chunks', count(*) FROM n WHERE type = 'CHUNK' UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'semantic_edges', count(*) FROM e WHERE type <> 'contains' UNION ALL SELECT 'edges:' || type, count(*) FROM e GROUP BY type")
def _(s, d):
    kind = F.when(F.col("l_returnflag") == "A", "agent_discovered").when(F.col("l_returnflag") == "N", "contains").otherwise("llm_triplet")
    nodes = _t(s, d, "orders").select(F.lit("DOCUMENT").alias("type")).unionByName(_t(s, d, "part").select(F.lit("CHUNK").alias("type")))
    return E.graph_totals(nodes, _t(s, d, "lineitem").select(kind.alias("type")), G.SEMANTIC)


@query("degree", "SELECT node, count(*) AS degree FROM (SELECT 'o' || o_orderkey AS node FROM orders UNION ALL SELECT 'c' || o_custkey FROM orders) GROUP BY node")
def _(s, d):
    e = _t(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))
    return G.degrees(e, "a", "b")


# ---- scenarios ----


@query("priority_rank", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_linestatus = 'O' AND l_discount * 10 >= 0.7 THEN 2 WHEN l_linestatus = 'O' THEN 3 ELSE 4 END AS priority FROM lineitem")
def _(s, d):
    kind = F.when(F.col("l_returnflag") == "A", "agent_discovered").otherwise("other")
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.priority(kind, F.col("l_linestatus") == "O", F.col("l_discount") * 10).alias("priority"))


@query("round_robin", "SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS round FROM orders")
def _(s, d):
    return G.round_robin(_t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "round")


@query("pair_dedupe", "SELECT a, b, first_seq FROM (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, min(l_orderkey * 10 + l_linenumber) AS first_seq FROM lineitem GROUP BY 1, 2)")
def _(s, d):
    rows = _t(s, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = G.first_of_pair(rows, "l_partkey", "l_suppkey", "seq")
    return out.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("seq").alias("first_seq"))


@query("budget_report", "WITH c AS (SELECT o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1) SELECT kind, n, n / sum(n) OVER () AS actual, 0.2 AS target FROM c")
def _(s, d):
    rows = _t(s, d, "orders").select(F.col("o_orderpriority").alias("kind"))
    return G.budget_report(rows, "kind", rows.distinct().withColumn("target", F.lit(0.2)))


@query("quality_filter", "WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[^\\s\\p{Z}]+')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn AS src, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(a.w) > 0 AND len(b.w) > 0) SELECT conv_id, src FROM p WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) <= 0.20")
def _(s, d):
    rows = _t(s, d, "conversations").select("conv_id", "turn", T.tokens(F.lower("text")).alias("w")).filter(F.size("w") > 0)
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return rows.join(after, ["conv_id", "turn"]).filter(T.jaccard(F.col("w"), F.col("w2")) <= 0.20).select("conv_id", F.col("turn").alias("src"))


# ---- judging; events carry scores ----

JUDGE_SQL = "least(1.0, greatest(0.0, coalesce({}, 0.0)))"


@query("judge_combine", "WITH s AS (SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS g, 1 - least(1.0, greatest(0.0, value / 400)) AS acc, least(1.0, greatest(0.0, (user_id % 10) / 9.0)) AS a, least(1.0, greatest(0.0, (event_id % 7) / 6.0)) AS b FROM events) SELECT event_id, round(g, 6) AS groundedness_score, round(acc, 6) AS answer_accuracy_score, round((a + b) / 2, 6) AS two_hop_score, g >= 0.8 AND acc >= 0.8 AND (a + b) / 2 >= 0.8 AS passed, a < 0.8 AS question_is_faulty FROM s")
def _(s, d):
    j = G.judge(F.col("value") / 100, F.col("value") / 400, (F.col("user_id") % 10) / 9.0, (F.col("event_id") % 7) / 6.0)
    scores = [F.round(j[k], 6).alias(k) for k in ("groundedness_score", "answer_accuracy_score", "two_hop_score")]
    return _t(s, d, "events").select("event_id", *scores, j["passed"].alias("passed"), j["question_is_faulty"].alias("question_is_faulty"))


@query("best_attempt", "SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS passed FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE -o_orderkey END) = 1")
def _(s, d):
    rows = _t(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("passed"))
    return G.best_attempt(rows, "o_custkey", "o_orderkey", "passed")


@query("target_prefix", "SELECT o_custkey, o_orderkey FROM (SELECT *, coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) WHERE before < 2")
def _(s, d):
    rows = _t(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "F").alias("passed"))
    return G.target_prefix(rows, "o_custkey", "o_orderkey", "passed", 2).select("o_custkey", "o_orderkey")


@query("drop_failed", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality = 1, true)")
def _(s, d):
    rows = _t(s, d, "documents").join(_t(s, d, "labels").withColumnRenamed("quality", "q"), "doc_id", "left")
    return rows.filter(F.coalesce(F.col("q") == 1, F.lit(True))).select("doc_id")


# ---- exports and operations ----


@query("job_stage_stats", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE gap IS NOT NULL) AS n_gaps, CAST(sum(gap) AS BIGINT) AS seconds FROM (SELECT event_type, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY event_type")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_timestamp("ts")
    rows = _t(s, d, "events").withColumn("gap", sec - F.lag(sec).over(w))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("gap").alias("n_gaps"), F.sum("gap").alias("seconds"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, keyphrases, IDF, shared phrases, rank: the 20 best pairs of chunks of different documents.

    A keyphrase is any word that G.post_filter leaves without a list of banned ones: three characters or more, not all digits.
    """
    docs = _t(spark, d, "documents")
    chunks = M.split_long(docs, "doc_id", "text", 256).filter("token_count >= 50").withColumn("chunk", F.concat_ws(":", "doc_id", "piece"))
    words = F.filter(F.array_distinct(T.tokens(F.lower("content"))), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))
    sets = chunks.select("chunk", words.alias("words"))
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        sets = sets.groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    sets = cut(sets, "flagship-words")
    common = F.array(*[F.lit(w) for w in G.too_common(sets, "words")]).cast("array<string>")
    pruned = sets.select("chunk", F.substring_index("chunk", ":", 1).alias("doc"), F.array_except("words", common).alias("words"))
    return G.top_shared_pairs(pruned, "chunk", "doc", "words", 20)


register("flagship", flagship)
