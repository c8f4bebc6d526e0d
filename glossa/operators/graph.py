"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.runtime import cut


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected graph; the component is its least node.

    Large-star joins every larger neighbour of a node to the least node around
    it, small-star does so for the smaller ones; both keep components together
    and a graph becomes a set of stars in a number of rounds that grows with the
    logarithm of its longest chain. Each step is an aggregation (with map-side
    combine) and a join on the node; a hub's edges are spread over ``SALTS``
    keys so that one node holding a large share of the edges isn't one task.

    Null ends are ignored, self links give a component of one node, repeated
    links count once, and an empty table gives an empty table.
    """
    e = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _star(both, larger=True)
        e = cut(_star(big, larger=False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    linked = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().join(linked.select("node"), "node", "left_anti")
    known = linked.unionByName(roots.select("node", F.col("node").alias("component")))
    alone = loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone)


SALTS = 16


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (u, v); for large-star both directions are given, for small-star u > v."""
    if not larger:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    spread_least = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    j = salted.join(spread_least, ["u", "s"])
    if larger:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
