"""Connected components of large graphs by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node of its component.

    ``edges`` holds (a, b) of one ordered type; loops and repeats are harmless. Each round
    points a node's larger neighbours to its smallest one (large star), then its smaller neighbours
    and itself (small star), which ends after about log(n) rounds in one star per component. Rounds are tables
    in the shared folder, so a lost executor costs the running round only. No node's
    neighbours are ever gathered: minima are combined before they are shuffled.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct()).distinct()
        before = state
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = written(large, "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = written(small.union(least.select("a", "m")).distinct(), "small_star")
