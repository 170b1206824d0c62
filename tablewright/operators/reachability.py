"""Reachability kept up to date, impact of every node, and cycles, over edge tables (parent, child).

All of these go in rounds over what changed in the round before; each round is written to the shared folder, which cuts its
lineage. Rounds grow with the depth of the graph, not with its size.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.operators.graph import LOW_IMPACT, MEDIUM_IMPACT, written
from tablewright.operators.near import apart, meet
from tablewright.plans.scratch import Scratch

#: Values that a node's sketch of what it reaches holds: more than the largest bound of a level, so that levels are exact.
RANKS = 16


def changed_edges(edges: DataFrame, added: DataFrame, removed: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``edges`` after a batch; an edge both removed and added is there. An edge that is there more than once may stay so."""
    scratch, ends = scratch or Scratch(edges.sparkSession, "changes"), ["parent", "child"]
    added = scratch.table(added.select(*ends).distinct(), "added")
    changed = scratch.table(removed.select(*ends).unionByName(added), "changed")
    return apart(edges.select(*ends), ends, changed, scratch).unionByName(added)


def updated_reach(reached: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, distance) of a search after a batch of edges, from its result before (``reached``, starts at 0) and the ``edges`` after.

    A node at some distance is supported by its parents one step nearer. Where a removed edge took the last of them, the node is
    lost, and its children are looked at again: supports lead to the starts, so cycles can't support themselves. Lost
    nodes are then found anew from parents that stayed, and shorter ways through added edges are followed, as long as
    anything improves. Edges that leave from what was reached are written once; only rounds that find other nodes read all edges,
    and no round moves more than those near a change. Edges may repeat.
    """
    before = now = scratch.table(reached.select("id", "distance"), "reached")
    edges = edges.select("parent", "child")
    within = scratch.table(meet(edges, ["parent"], now.select(F.col("id").alias("parent")), scratch, "left_semi").select("parent", "child"), "within")
    at = lambda side: now.select(F.col("id").alias(side), F.col("distance").alias(f"{side}_distance"))
    doubted = removed.select("parent", "child").join(at("parent"), "parent").join(at("child"), "child").filter("child_distance = parent_distance + 1")
    doubted = scratch.table(doubted.select(F.col("child").alias("id"), F.col("child_distance").alias("distance")).distinct(), "doubted")
    all_lost = []
    while not doubted.isEmpty():
        ways = meet(within.select("parent", F.col("child").alias("id")), ["id"], doubted, scratch).join(at("parent"), "parent")
        held = ways.filter("parent_distance = distance - 1").select("id").distinct()
        lost = scratch.table(doubted.join(held, "id", "left_anti"), "lost")
        if lost.isEmpty():
            break
        all_lost.append(lost.select("id"))
        now = scratch.table(now.join(lost.select("id"), "id", "left_anti"), "left")
        next_ = meet(within, ["parent"], lost.select(F.col("id").alias("parent"), (F.col("distance") + 1).alias("distance")), scratch).select(F.col("child").alias("id"), "distance")
        doubted = scratch.table(next_.distinct().join(now, ["id", "distance"], "left_semi"), "doubted")
    # Ways to lost nodes from those that stayed, and over added edges that are still there.
    added = scratch.table(added.select("parent", "child").distinct(), "added")
    anew = added if added.isEmpty() else meet(edges, ["parent", "child"], added, scratch, "left_semi")
    if all_lost:
        lost = functools.reduce(DataFrame.unionByName, all_lost).distinct()
        anew = anew.unionByName(meet(within, ["child"], lost.withColumnRenamed("id", "child"), scratch, "left_semi").select("parent", "child"))
    ways = anew.join(at("parent"), "parent").select(F.col("child").alias("id"), (F.col("parent_distance") + 1).alias("distance"))
    while True:
        best = ways.groupBy("id").agg(F.min("distance").alias("distance"))
        known = now.select("id", F.col("distance").alias("known"))
        better = scratch.table(best.join(known, "id", "left").filter("known IS NULL OR distance < known").select("id", "distance"), "better")
        if better.isEmpty():
            return now
        now = scratch.table(now.join(better.select("id"), "id", "left_anti").unionByName(better), "reached")
        links = within if better.join(before.select("id"), "id", "left_anti").isEmpty() else edges
        ways = meet(links, ["parent"], better.withColumnRenamed("id", "parent"), scratch).select(F.col("child").alias("id"), (F.col("distance") + 1).alias("distance"))


def impact_levels(edges: DataFrame, scratch: Scratch, ranks: int = RANKS) -> DataFrame:
    """(id, reached, level) of every node: how many nodes depend on it, up to ``ranks``, and how grave a change is.

    A node's sketch holds the ``ranks`` least hashes of the nodes that it reaches. Sketches are carried up the edges, only what is
    new in a round moves on, and no pair of nodes is listed. A sketch that is not full holds all there is, so with more
    ranks than the largest bound levels are exact. Edges to nodes without edges of their own count in the first round only, and
    later ones read the others. Cycles end, as nothing new comes; a node doesn't count as its own dependent.
    """
    edges = written(edges, scratch)
    links = edges.filter("parent <> child")
    # The ranks + 1 least values of a node: its own, which comes back over a cycle, is taken out at the end.
    place = F.dense_rank().over(Window.partitionBy("id").orderBy("value"))
    least = lambda df: df.withColumn("place", place).filter(F.col("place") <= ranks + 1).groupBy("id").agg(F.sort_array(F.collect_set("value")).alias("values"))
    first = scratch.table(least(links.select(F.col("parent").alias("id"), F.xxhash64("child").alias("value"))), "sketches")
    inner = scratch.table(meet(links, ["child"], first.select(F.col("id").alias("child")), scratch, "left_semi").select("parent", "child"), "inner")
    carriers = scratch.table(inner.select(F.col("parent").alias("id")).distinct(), "carriers")
    now = scratch.table(meet(first, ["id"], carriers, scratch, "left_semi"), "sketches")
    ways = inner.join(first.withColumnRenamed("id", "child"), "child")
    while True:
        told = least(ways.select(F.col("parent").alias("id"), F.explode("values").alias("value"))).withColumnRenamed("values", "told")
        both = now.select("id", F.col("values").alias("old")).join(told, "id", "left")
        values = F.when(F.col("told").isNull(), F.col("old")).otherwise(F.slice(F.sort_array(F.array_union("old", "told")), 1, ranks + 1))
        before, now = now, scratch.table(both.withColumn("values", values).select("id", "values", F.array_except("values", "old").alias("fresh")), "sketches")
        scratch.drop(before)
        moved = now.filter(F.size("fresh") > 0).select(F.col("id").alias("child"), F.col("fresh").alias("values"))
        if moved.isEmpty():
            break
        ways = meet(inner, ["child"], moved, scratch)
    others = lambda df: df.select("id", F.least(F.size(F.filter("values", lambda v: v != F.xxhash64("id"))), F.lit(ranks)).alias("reached"))
    named = edges.select(F.col("child").alias("id")).unionByName(edges.filter("parent IS NULL OR child IS NULL").select(F.col("parent").alias("id")))
    # Sketches only grow, so a node's last one has its largest number.
    counted = named.withColumn("reached", F.lit(0)).unionByName(others(first)).unionByName(others(now)).groupBy("id").agg(F.max("reached").cast("long").alias("reached"))
    return counted.withColumn("level", F.when(F.col("reached") <= LOW_IMPACT, "low").when(F.col("reached") <= MEDIUM_IMPACT, "medium").otherwise("high"))


def _trimmed(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges less those that can't be on a cycle because nothing leads to them or they lead to nothing."""
    n, now = None, edges
    while True:
        now = scratch.table(now.join(now.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(now.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "trimmed")
        before, n = n, now.count()
        if n in (0, before):
            return now


def cycles(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component, size) of all nodes on cycles: strongly connected components, each named by its least node.

    The greatest node that reaches a node colours it; from each node that has its own colour, what leads back to it within the
    colour is one component. Components leave and the rest is coloured again. A node with an edge to itself is a component
    of size 1. Nodes on no cycle are left out.
    """
    edges = scratch.table(edges.select("parent", "child").distinct(), "edges")
    loops = edges.filter("parent = child").select(F.col("parent").alias("node"))
    now, found = edges.filter("parent <> child"), []
    while True:
        now = _trimmed(now, scratch)
        if now.isEmpty():
            break
        colour = scratch.table(now.select(F.col("parent").alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        moved = colour
        while not moved.isEmpty():
            told = now.join(moved.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.max("colour").alias("told"))
            joined = colour.join(told, "node", "left").withColumn("is_new", F.coalesce(F.col("told") > F.col("colour"), F.lit(False)))
            joined = scratch.table(joined.select("node", F.greatest("colour", "told").alias("colour"), "is_new"), "colour")
            colour, moved = joined.select("node", "colour"), joined.filter("is_new").select("node", "colour")
        inside = now.join(colour.select(F.col("node").alias("parent"), "colour"), "parent").join(colour.select(F.col("node").alias("child"), F.col("colour").alias("c")), "child")
        inside = scratch.table(inside.filter("colour = c").select("parent", "child"), "inside")
        members = front = scratch.table(colour.filter("node = colour"), "members")
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("child"), "colour"), "child").select(F.col("parent").alias("node"), "colour").distinct()
            front = scratch.table(back.join(members.select("node"), "node", "left_anti"), "front")
            members = members.unionByName(front)
        members = scratch.table(members, "members")
        found.append(members)
        gone = members.select("node")
        now = now.join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("node", "child"), "child", "left_anti").select("parent", "child")
    each = loops.withColumn("colour", F.col("node"))
    if found:
        every = functools.reduce(DataFrame.unionByName, found)
        large = every.groupBy("colour").agg(F.count("*").alias("size")).filter("size > 1").select("colour")
        whole = every.join(large, "colour", "left_semi").select("node", "colour")
        each = whole.unionByName(loops.join(whole, "node", "left_anti").withColumn("colour", F.col("node")))
    named = each.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return scratch.table(each.join(named, "colour").select("node", "component", "size"), "cycles")
