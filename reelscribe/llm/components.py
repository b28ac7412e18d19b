"""Connected components by alternating large and small stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, kept


def state_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """``a, b``: each linked node with the least node of its component (which has no row itself).

    Takes ``links(a, b)`` of longs; order, repeats and loops don't matter. A large star points a node's greater
    neighbours to its least one, a small star the others; both only aggregate and join on a node, so a hub is
    pre-aggregated and no task holds a component. The rounds are logarithmic in a component's size.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = state_of(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last = edges
        edges = kept(small.unionByName(floor.select("a", F.col("m").alias("b"))).distinct(), "stars")
        discard(last)
        before, state = state, state_of(edges)
        if state == before:
            return edges
