"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over ``links`` (a, b), both long.

    Every node of a link that joins two different nodes is returned once. Each step joins every
    neighbour to the smallest one known, first among larger neighbours, then among smaller; neighbour
    lists are never gathered, only their minimum, so a node with very many links is no large group.
    """
    pair = F.array_sort(F.array("a", "b"))
    edges = stored(links.where("a <> b").select(pair[0].alias("a"), pair[1].alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        down = large.where("a <> b").distinct()
        # Small star: among b's smaller neighbours, all go to the smallest.
        low = down.groupBy("b").agg(F.min("a").alias("m"))
        small = down.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = stored(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
