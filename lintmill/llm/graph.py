"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of ``edges(a, b)``; the root is its component's smallest vertex.

    Alternates large and small stars until nothing changes, in a number of
    rounds that grows with the logarithm of the longest path. A vertex meets
    its minimum by a join with a written table, so hot vertices can be split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select("v", F.col("v").alias("root"))).distinct()
        mark = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_stars")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "small_stars")
