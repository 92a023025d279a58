"""Connected components by alternating large and small stars (Kiveris et al. 2014) on DataFrames.

Every pass is two aggregates with map-side partial results and two joins, which adaptive execution splits
at hubs; passes end in tables of the shared folder. Nothing of the graph reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.llm.common import apart, cut, discard


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) of every node but the smallest of each component; edges: a, b.

    The result is a table that discard() can delete.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        seen = Observation()
        after = small.select("e.*").filter("u <> v").distinct()
        after = cut(after.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "cc")
        discard(now)
        now, before = after, mark
        mark = seen.get  # gathered while the pass was written
        if mark == before:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._wg_path = now._wg_path
            return out
