"""Connected components by alternating large and small stars, on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node of its component, and
    has a row itself. Each round is written, and no node's neighbours are gathered in one task."""
    star = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = star.union(star.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        star = stored(small.select("e.a", "e.b").where("a != b").distinct())
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count_if(F.col("b") > F.col("a"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
