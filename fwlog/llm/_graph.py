"""Shared folder for intermediate tables, and connected components by joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fwlog.session import checkpointed


saved = checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (smallest node reachable) of an edge table with columns a, b.

    Alternates large-star and small-star steps: every node ties its larger neighbours,
    then its smaller ones and itself, to the smallest it knows. Only minima are
    aggregated, so a node with many neighbours is never gathered. Edges with a null end
    and loops are dropped; nodes without an edge are not returned.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .filter("a > b and b is not null").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.filter("a > b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = saved(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
