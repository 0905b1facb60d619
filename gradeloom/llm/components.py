"""Connected components of a table of links."""

from pyspark.sql import DataFrame, functions as F

from .shared import release, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the smallest node it reaches.

    Alternates two steps until nothing changes: every node points its larger neighbours at the smallest of its neighbourhood, then
    every node points itself and its smaller neighbours there. Minima are partial aggregates and neighbourhoods are never
    gathered, so a node with very many links is spread by the join. Each round is written to the shared folder.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large, "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
                 .union(lowest.select("a", "m")).distinct())
        before, edges = edges, stored(small, "links")
        release(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        state = now
