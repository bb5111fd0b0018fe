"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Alternates large-star and small-star steps. Each is one minimum by key,
    combined before the shuffle, and one join on the same key, whose hot keys
    adaptive execution splits; nothing but two counts comes to the driver. Edges may
    repeat, in either direction; loops and edges with a null end tie nothing and make no
    node; no edges give no rows. Rounds are not cut short: if ``max_rounds`` don't settle it, that is an error.
    """
    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = cut(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node is tied to the node's least neighbour
        links = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = links.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every neighbour below a node, and the node, are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
