"""Connected components of a link table, in Spark: large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import salted_join, stage_table


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``a, b`` (bigint) to ``node, component``: the smallest node that each node reaches.

    Each round rewires every edge towards the smallest neighbour; rounds grow with the logarithm of
    the longest path.  Only sums reach the driver, every round is written once, and a node of very
    many links is spread by salting.
    """
    sums = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = None
    links = stage_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours of a go to its smallest neighbour (or itself)
        large = (salted_join(both, least, ["a"], F.col("b")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b"))
        # small star: a and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (salted_join(large, low, ["a"], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        new = stage_table(small, "links")
        after = sums(new)
        links = new
        if after == before or not after[0]:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
