"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (with map-side combine) and a join on the node; nothing is collected. The steps'
results are tables in the shared folder. Nodes with very many neighbours are split by Spark's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import common


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b of type long); the root is the smallest node."""
    kept = common.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _sum(kept)
    while before[0]:
        both = kept.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(kept.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least.hint("merge"), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = common.stage(small.distinct(), "small-star")
        common.drop(kept)
        common.drop(large)
        kept, after = new, _sum(new)
        if after == before:
            break
        before = after
    stars = kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
