"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.sources.scratch import discard, written


def roots(down: DataFrame) -> DataFrame:
    """``down`` (a, to), pointers to smaller nodes, with every pointer moved on to the node where its path ends.

    Pointers jump to their pointer's target until none moves, so a path of n
    hops takes log2(n) rounds.
    """
    while True:
        next_hop = down.select(F.col("a").alias("to"), F.col("to").alias("next")).where("to != next")
        jumped = written(down.join(next_hop, "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jumps")
        discard(down)
        down = jumped.select("a", "to")
        if not jumped.where("moved").take(1):
            return down


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round points every node at its smallest neighbour (a grouped minimum,
    so a node with many edges is pre-aggregated), follows pointers to the nodes
    that are smaller than all their neighbours, renames the edges by that and
    drops those inside one group.  No two such nodes are neighbours, so every
    component shrinks at least by half: log2(n) rounds, each of at most log2(n)
    jumps, whatever the shape.  Rounds are written to the shared folder; nodes
    meet the rounds' pointers in one job at the end.
    """
    ordered = lambda df, x, y: df.where(f"{x} != {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    edges = written(ordered(edges, "a", "b"), "edges")
    hops = []
    while edges.take(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = roots(written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "hops"))
        hops.append(down)
        left = edges.join(down.withColumnRenamed("to", "x"), "a").select("x", "b")
        renamed = written(ordered(left.join(down.select(F.col("a").alias("b"), F.col("to").alias("y")), "b"), "x", "y"), "edges")
        discard(edges)
        edges = renamed
    if not hops:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = hops[0].select(F.col("a").alias("node"), F.col("to").alias("component"))
    for hop in hops[1:]:
        labels = labels.join(hop.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = written(labels, "labels")
    for hop in hops:
        discard(hop)
    return out
