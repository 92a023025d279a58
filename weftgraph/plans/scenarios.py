"""Queries of scenarios, budgets and graph loading, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import similarity as X
from weftgraph.operators import scenario as S
from weftgraph.plans.core import _t, query
from weftgraph.sources.graphs import without_dangling

PHRASES = "t AS (SELECT DISTINCT d, unnest(string_split_regex(lower(d), '[\\s_-]+')) AS w FROM (SELECT p_name || ' ' || p_type || ' ' || p_brand AS d FROM part))"


@query("fuzzy_kp_match", f"WITH {PHRASES}, n AS (SELECT d, count(*) AS n FROM t GROUP BY d), p AS (SELECT x.d AS a, y.d AS b, count(*) AS k FROM t x JOIN t y ON x.w = y.w AND x.d < y.d GROUP BY x.d, y.d) SELECT a, b, CASE WHEN length(b) < length(a) THEN b ELSE a END AS canonical FROM p JOIN n u ON u.d = a JOIN n v ON v.d = b WHERE k / (u.n + v.n - k) >= 0.6")
def _(s, d):
    phrases = _t(s, d, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("d"))
    rows = phrases.select("d", F.explode(F.split(F.lower("d"), r"[\s_-]+")).alias("w"))
    pairs = X.jaccard_join(rows, "d", "w", 0.6)
    return pairs.select("a", "b", F.when(F.length("b") < F.length("a"), F.col("b")).otherwise(F.col("a")).alias("canonical"))


@query("theme_fallback", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN p_type WHEN p_size % 4 = 2 THEN 'x' ELSE 'x/' || p_name END AS themes FROM part")
def _(s, d):
    k = F.col("p_size") % 4
    items = F.when(k == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    b = F.when(k == 2, F.array(F.lit("x"), F.lit("z"))).otherwise(F.array("p_name"))
    got = S.themes(items, F.when(k == 1, F.col("p_type")), F.array(F.lit("x")), b)
    return _t(s, d, "part").select("p_partkey", F.array_join(got, "/").alias("themes"))


@query("qualify_types", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' ELSE 'F/O' END AS types FROM orders")
def _(s, d):
    return _t(s, d, "orders").select("o_orderkey", F.array_join(S.qualified(F.array("o_orderstatus"), ["F", "O"]), "/").alias("types"))


@query("graph_load", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(s, d):
    return without_dangling(_t(s, d, "orders"), _t(s, d, "customer").filter("c_acctbal > 0"), "o_orderkey", "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("assign_types")
def _(s, d):
    rows = _t(s, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("factual"))).otherwise(F.array(F.lit("factual"), F.lit("integration"))).alias("types"))
    return S.assign_types(rows, "o_custkey", "o_orderkey", "types", {"factual": 0.5, "integration": 0.5}).drop("types")
