"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import scratch, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a long, b long).

    Large-star and small-star rounds (Kiveris et al., 2014) pull every node towards the smallest one
    around it until each hangs on its root: a number of rounds logarithmic in the number of nodes.
    A node's least neighbour is an aggregate that combines before the shuffle, and is written before its
    links are joined with it: the join then reads two plain shuffles, which adaptive execution
    splits where a node has very many links. Every round ends in a written table.

    Links of a node to itself, repeated links, and links with a null end change nothing.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, before = written(pairs, "links"), None
    while True:
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with scratch(links.sparkSession):
            least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
            large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
            least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            stars = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star", stays=True)
