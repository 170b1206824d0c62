"""Lineage over node and edge tables.

Searches run as rounds over a frontier: one join with the edges, less what was seen. The number of rounds is the graph's
depth, not its size. Each round is written to the shared folder, which cuts its lineage. Edges are written once, as they come,
and read by each round, which moves only edges that may leave from its frontier.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.near import meet
from tablewright.plans.scratch import Scratch

#: An impact reaches as far as this; and is low or medium up to so many models.
IMPACT_DEPTH, LOW_IMPACT, MEDIUM_IMPACT = 100, 3, 10


def written(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (parent, child) as a written table, for several searches; those that are one stay."""
    return edges if hasattr(edges, "_scratch_path") else scratch.table(edges.select("parent", "child"), "edges")


def reach(edges: DataFrame, starts: DataFrame, direction: str = "downstream", depth: int | None = IMPACT_DEPTH) -> DataFrame:
    """(id, distance) of what ``starts`` (id) reach along ``edges`` (parent, child) within ``depth``, shortest first.

    Without a depth the search goes on until it finds nothing new. Starts are left out; cycles end because nothing is visited
    twice. Edges may repeat.
    """
    scratch = Scratch(edges.sparkSession, "lineage")
    source, target = ("parent", "child") if direction == "downstream" else ("child", "parent")
    links = written(edges, scratch).select(F.col(source).alias("from_id"), F.col(target).alias("id"))
    seen = frontier = scratch.table(starts.select("id").distinct().withColumn("distance", F.lit(0)), "start")
    distance = 0
    while depth is None or distance < depth:
        distance += 1
        met = meet(links, ["from_id"], frontier.select(F.col("id").alias("from_id")), scratch, "left_semi").select("id").distinct()
        frontier = scratch.table(met.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(distance)), f"round{distance}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("distance > 0")


def lineage(edges: DataFrame, start: str, direction: str = "downstream", depth: int = 10) -> DataFrame:
    return reach(edges, _node(edges, start), direction, depth)


def _node(edges: DataFrame, name: str) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(name).alias("id"))


def lineage_counts(edges: DataFrame, start: str, depth: int = 10) -> DataFrame:
    """One row: upstream, downstream, total."""
    edges = written(edges, Scratch(edges.sparkSession, "lineage"))
    up = lineage(edges, start, "upstream", depth).agg(F.count("*").alias("upstream"))
    down = lineage(edges, start, "downstream", depth).agg(F.count("*").alias("downstream"))
    return up.crossJoin(down).withColumn("total", F.col("upstream") + F.col("downstream"))


def impact(edges: DataFrame, nodes: DataFrame, start: str) -> DataFrame:
    """(type, n, total, level): everything downstream by type, and how grave that is. Nodes (id, type) may repeat."""
    reached = lineage(edges, start, "downstream", IMPACT_DEPTH).select("id")
    types = meet(nodes.select("id", "type"), ["id"], reached, Scratch(edges.sparkSession, "impact"), "left_semi").distinct().groupBy("type").agg(F.count("*").alias("n"))
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    level = F.when(F.col("total") <= LOW_IMPACT, "low").when(F.col("total") <= MEDIUM_IMPACT, "medium").otherwise("high")
    return types.crossJoin(F.broadcast(total)).withColumn("level", level)


def affected_by_distance(edges: DataFrame, start: str, depth: int = IMPACT_DEPTH) -> DataFrame:
    return lineage(edges, start, "downstream", depth).groupBy("distance").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def signed_levels(edges: DataFrame, focus: str, depth: int = 10) -> DataFrame:
    """(id, level): 0 at the focus, +n upstream, -n downstream; the nearer side wins, upstream on a tie."""
    edges = written(edges, Scratch(edges.sparkSession, "lineage"))
    up = lineage(edges, focus, "upstream", depth).withColumnRenamed("distance", "up")
    down = lineage(edges, focus, "downstream", depth).withColumnRenamed("distance", "down")
    nearer = F.when(F.col("down").isNull() | (F.col("up") <= F.col("down")), F.col("up")).otherwise(-F.col("down"))
    return up.join(down, "id", "full_outer").select("id", nearer.alias("level")).unionByName(_node(edges, focus).withColumn("level", F.lit(0)))


def checksum(df: DataFrame, key: str) -> DataFrame:
    """(key, digest) over all other columns by name order; null and empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(df.columns) if c != key]
    return df.select(key, F.md5(F.concat_ws("|", *parts)).alias("digest"))


def version_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): changed, added or removed keys between two versions."""
    a, b = checksum(old, key).withColumnRenamed("digest", "old"), checksum(new, key).withColumnRenamed("digest", "new")
    both = a.join(b, key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def invalidated(edges: DataFrame, changed: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, distance): changed nodes at 0 and all that depends on them, however far, unless ``depth`` is given."""
    return reach(edges, changed, "downstream", depth).unionByName(changed.select("id").distinct().withColumn("distance", F.lit(0)))


def matcher(rule: dict) -> Column:
    """A layer rule as one predicate.

    Leaf fields (folder prefix on a boundary, name_prefix, name_regex, tag, materialized) must all hold. ``any`` or ``all``
    nest rules, and hide leaf fields beside them; ``any`` hides ``all``. An empty rule matches nothing.
    """
    if rule.get("any"):
        return functools.reduce(lambda a, b: a | b, map(matcher, rule["any"]))
    if rule.get("all"):
        return functools.reduce(lambda a, b: a & b, map(matcher, rule["all"]))
    leaves = []
    if "folder" in rule:
        folder = rule["folder"].rstrip("/")
        leaves.append((F.col("path") == folder) | F.col("path").startswith(folder + "/"))
    if "name_prefix" in rule:
        leaves.append(F.col("name").startswith(rule["name_prefix"]))
    if "name_regex" in rule:
        leaves.append(F.col("name").rlike(rule["name_regex"]))
    if "tag" in rule:
        leaves.append(F.array_contains("tags", rule["tag"]))
    if "materialized" in rule:
        leaves.append(F.col("materialized") == rule["materialized"])
    return F.coalesce(functools.reduce(lambda a, b: a & b, leaves), F.lit(False)) if leaves else F.lit(False)


def classify_layers(nodes: DataFrame, layers: Sequence[tuple[str, dict]]) -> DataFrame:
    """``nodes`` (name, path, tags, materialized) with the first layer that matches, or null."""
    return nodes.withColumn("layer", functools.reduce(lambda other, x: F.when(matcher(x[1]), x[0]).otherwise(other), reversed(list(layers)), F.lit(None).cast("string")))


def suggest_by_folder(nodes: DataFrame, part: Column, least: int = 2, most: int = 8) -> DataFrame:
    """(layer, n) by sub-folder, if there are ``least`` to ``most`` of them; else nothing."""
    buckets = nodes.select(part.alias("layer")).filter("layer IS NOT NULL AND layer <> ''").groupBy("layer").agg(F.count("*").alias("n"))
    how_many = buckets.agg(F.count("*").alias("buckets"))
    return buckets.crossJoin(F.broadcast(how_many)).filter(F.col("buckets").between(least, most)).select("layer", "n")


def suggest_by_tag(tags: DataFrame, total: DataFrame, vocabulary: Sequence[str] = (), coverage: float = 0.3, top: int = 5) -> DataFrame:
    """(layer, n) from (tag, n): known words if any covers enough, else the most frequent tags that together do.

    ``total`` is one row (total) with the number that shares are of.
    """
    known = tags.filter(F.lower("tag").isin(*vocabulary)) if vocabulary else tags.limit(0)
    covers = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(F.broadcast(total)).select((F.col("n") >= F.col("total") * coverage).alias(name))
    enough = covers(known, "use_known")
    ranked = tags.orderBy(F.desc("n"), "tag").limit(top)
    reached = covers(ranked, "enough")
    a = known.crossJoin(F.broadcast(enough)).filter("use_known").select("tag", "n")
    b = ranked.crossJoin(F.broadcast(enough)).crossJoin(F.broadcast(reached)).filter("NOT use_known AND enough").select("tag", "n")
    return a.unionByName(b).withColumnRenamed("tag", "layer")


def suggest_by_prefix(names: DataFrame, least: int = 3, share: float = 0.05, top: int = 6) -> DataFrame:
    """(layer, n) of name prefixes before ``_`` or a space that enough names have; at most ``top``, most frequent first."""
    total = names.agg(F.count("*").alias("total"))
    n = names.select(F.regexp_extract("name", r"^([A-Za-z]+)[_ ]", 1).alias("layer")).filter("layer <> ''").groupBy("layer").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(least), F.col("total") * share)).orderBy(F.desc("n"), "layer").limit(top).select("layer", "n")


def inventory(nodes: DataFrame) -> DataFrame:
    """(kind, value, n): nodes by type, by tag and by folder, and for names of several packages the number of these."""
    facets = F.array_union(F.array(F.struct(F.lit("type").alias("kind"), F.col("type").alias("value")), F.struct(F.lit("folder").alias("kind"), F.col("path").alias("value"))), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))))
    counted = nodes.select(F.explode(facets).alias("f")).groupBy("f.kind", "f.value").agg(F.count("*").alias("n"))
    return counted.unionByName(duplicate_names(nodes).select(F.lit("duplicate name").alias("kind"), F.col("name").alias("value"), F.col("packages").alias("n")))


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """Names that more than one package has."""
    return nodes.groupBy("name").agg(F.countDistinct("package").alias("packages")).filter("packages > 1")


def column_lineage(col_edges: DataFrame, model: str, column: str, depth: int = 10) -> DataFrame:
    """(id, distance) of all columns upstream of one, over (source_model, source_column, target_model, target_column)."""
    edges = col_edges.select(F.concat_ws(".", "source_model", "source_column").alias("parent"), F.concat_ws(".", "target_model", "target_column").alias("child"))
    return lineage(edges, f"{model}.{column}", "upstream", depth)


def unused_columns(declared: DataFrame, col_edges: DataFrame, wildcard: DataFrame) -> DataFrame:
    """Declared (model, column) without an outgoing edge, but for models that are read by wildcard (model)."""
    used = col_edges.select(F.col("source_model").alias("model"), F.col("source_column").alias("column"))
    return declared.join(used, ["model", "column"], "left_anti").join(wildcard, "model", "left_anti")


def orphans_and_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind) of nodes without parents (orphan) and without children (leaf)."""
    orphan = nodes.select("id").join(edges.select(F.col("child").alias("id")), "id", "left_anti").withColumn("kind", F.lit("orphan"))
    leaf = nodes.select("id").join(edges.select(F.col("parent").alias("id")), "id", "left_anti").withColumn("kind", F.lit("leaf"))
    return orphan.unionByName(leaf)
