"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.plans.scratch import release


def connected_components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is the
    smallest node that can be reached.

    Alternating large-star and small-star rounds: every round turns the edge
    set into one of at most the same size with the same components, until it
    is a set of stars, after O(log^2 n) rounds.  A hot node only ever appears
    as the key of an aggregate that Spark combines before the shuffle, never
    as a collected list, and no side is broadcast (all grow with the data).
    ``cut`` writes a table and reads it again, which ends the lineage of a
    round; the table of the round before is then deleted.  Null endpoints and
    loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = cut(e, "edges")
    if not e.take(1):
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = _fingerprint(e)
    while True:
        # large star: every neighbour above a node meets the least of the node's neighbourhood
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small star: a node and its lesser neighbours meet the least of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, cut(small, "edges")
        release(before)
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())


def _fingerprint(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
