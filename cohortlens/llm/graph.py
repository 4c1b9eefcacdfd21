"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component: the smallest node that can be reached.

    Each round is two joins on the node, so a node with very many edges can be split; lineage is cut after each.
    """
    e = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", "a").distinct())
        before = now
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b")
        e = durable(joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b")).filter("a < b").distinct())
