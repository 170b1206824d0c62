"""Connected components over an edge table by alternating large-star and small-star steps.

Each step joins every node's edges with its smallest neighbour. The table of smallest neighbours is written first, so
the join reads two plain exchanges and adaptive execution can split a hub's edges over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """One step over (a, b) with a > b: large-star links larger neighbours, small-star smaller ones, to the least."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    near = both.join(least, "a")
    if large:
        out = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # A node hangs its smaller neighbours and itself on the least of them.
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    done = scratch.table(out.filter("a <> b").distinct(), "star")
    scratch.drop(least)
    return done


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b longs); component is the smallest node reachable.

    Self-loops and repeated edges are ignored. Rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.table(pairs, "edges")
    mark = None
    while True:
        wide = _star(now, scratch, True)
        slim = _star(wide, scratch, False)
        scratch.drop(now, wide)
        now = slim
        # At the fixed point every node has one edge, to a least node that has none of its own.
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
