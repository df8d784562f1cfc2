"""Connected components of a graph of any size by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def components(edges: DataFrame) -> DataFrame:
    """edges: src, dst (longs). Returns id, component: the smallest id reachable, for each id of an edge but roots.

    Each round is written to the shared checkpoint folder, so neither lineage nor driver grows with the graph; rounds
    grow with the logarithm of its size.
    """
    e = materialised(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.col("u").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialised(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
