"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the
    smallest node that can be reached.

    Rounds of large-star and small-star (Kiveris et al., 2014): every node hands
    its larger, then its smaller neighbours to its smallest neighbour, until
    nothing changes.  Rounds grow with the logarithm of the links' diameter and
    each is stored; links never become more than twice as many.
    """
    both = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # Large star: each node sends its larger neighbours to the smallest of its neighbours and itself.
        sides = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node sends its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        both = stored(small.where("a <> b").distinct(), "links")
        now = both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return both.select(F.col("a").alias("node"), F.col("b").alias("component")).union(both.select("b", "b").distinct())
        before = now
