"""Connected components of an edge table, in rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import hubs, spread_join, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps, each a grouped minimum (combined before the
    shuffle) and a join, until no edge changes. Edges of a hub are joined in parts. Loops and repeated edges do no harm.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, total = None, edges.count()
    while True:
        # large star: greater neighbours of a node are linked to its least neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        greater = both.where("b > a")
        heavy = hubs(greater.groupBy("a").agg(F.count("*").alias("n")), "a", total)
        large = spread_join(greater, least, "a", "b", heavy).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        # small star: a node and its lesser neighbours are linked to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        heavy = hubs(large.groupBy("a").agg(F.count("*").alias("n")), "a", total)
        small = spread_join(large, least, "a", "b", heavy)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, "small-star")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if before is not None and tuple(now) == before:
            break
        before, total = tuple(now), now[0]
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
