"""Connected components over edge tables, by alternating star contractions.

Each round is two aggregations with map-side combining and two joins, broadcast or such that adaptive execution can split, so a node with
very many edges never lands in one task. Rounds are written to the shared folder until the edges are stars; edges that are so at
once take none. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch


def _contract(edges: DataFrame, large: bool, small: bool) -> DataFrame:
    """Hang every (large: greater; else: not greater) neighbour of a node on the least node around it."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(F.broadcast(least) if small else least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every child has one parent, and no parent is a child."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60, most_edges: int = 500_000) -> DataFrame:
    """(node, component): the least node reachable from each node of ``edges(u long, v long)``.

    Nodes without edges are absent. Repeated edges, loops and nulls are ignored. The least neighbours of up to ``most_edges`` edges' nodes are
    broadcast, so that a hub's edges stay where they are; beyond, edges are joined with them by a shuffle.
    """
    now = scratch.keep(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        # a contraction makes no more edges than it had, so this bounds what both of them broadcast
        small = now.limit(most_edges + 1).count() <= most_edges
        new = scratch.keep(_contract(_contract(now, True, small), False, small), "stars")
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
