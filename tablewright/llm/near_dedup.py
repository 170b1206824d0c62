"""Near-duplicate documents by bottom-k sketches from one hash function, confirmed on full shingle sets.

A sketch is the k smallest hashes of a document's shingle set. Inverted lists over pairs of neighbours in it generate
candidates: of two documents as similar as asked, at least m such pairs are the same, so the s - m + 1 rarest of each
document's s pairs suffice. Documents that share single shingles by chance, as more do the larger a corpus is, rarely
share two with none of either between them, so lists hold little but near copies; pairs by rarity keep common phrases out.

Lists are not expanded into pairs. Each list has a hub, the member that shares most values with the corpus, and
members are compared with their hub on sketches. Those that may reach the threshold are the hub's dense cluster and are
tested exactly against it; where that leaves a cluster in more than one component, documents outside the hub's component
are tested against all of the cluster in blocks of bounded size, and only confirmed links leave a block. Members that
only collide with their hub are compared with the rest of their list on sketches, again in blocks, and only pairs
that no dense cluster covers go on to the exact test.
"""

from __future__ import annotations

import functools
import math
import operator
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.graph import connected_components
from tablewright.operators.near import meet
from tablewright.plans.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Values that a sketch retains.
SKETCH = 64
#: Standard deviations that a sketch's estimate may fall short by, and the odds at which a list may miss a link.
SLACK, ODDS = 6.0, 2e-8
#: Stand before a sketch's first value and, where it is the whole set, after its last.
FIRST, LAST = -(1 << 63), (1 << 63) - 1
#: Shingles in a block of documents that one task tests against another block.
BLOCK_SHINGLES = 1 << 14
#: Documents of a list in a block.
BLOCK_DOCS = 128


def words_of(text: Column) -> Column:
    """Words between ASCII white space, with A-Z (and no other letter) in lower case."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_set(words: Column, width: int) -> Column:
    """Sorted distinct 64-bit hashes of ``width`` words in a row; the whole sequence where it is shorter; empty for none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    whole = F.array(F.xxhash64(F.lit("whole"), words))
    empty = F.array().cast("array<bigint>")
    return F.when(n >= width, F.sort_array(F.array_distinct(many))).when(n > 0, whole).otherwise(empty)


def neighbours(sketch: Column, n: Column, k: int = SKETCH) -> Column:
    """Hashes of every two values in a row of a sorted sketch, its ends among them: k of them, or n + 1 for a whole set."""
    of_two = F.zip_with(F.concat(F.array(F.lit(FIRST)), sketch), F.concat(sketch, F.array(F.lit(LAST))), lambda a, b: F.xxhash64(a, b))
    return F.slice(of_two, F.lit(1), F.when(n <= k, n + 1).otherwise(F.lit(k)))


@functools.cache
def least_runs(threshold: float, k: int) -> int:
    """Most neighbours that k values, each shared with odds of ``threshold``, have in common at all but ``ODDS``; at least 1."""
    # By whether the last value is shared: odds of every number of shared neighbours.
    shared, other = np.eye(1, k + 1)[0], np.zeros(k + 1)
    for _ in range(k):
        shared, other = threshold * (np.roll(shared, 1) + other), (1 - threshold) * (shared + other)
    return max(1, int(np.searchsorted(np.cumsum(shared + other), ODDS, "right")))


def needed_overlap(n: Column, threshold: float, k: int = SKETCH) -> Column:
    """Fewest neighbours that a document of ``n`` shingles shares with any document as similar as ``threshold``.

    A value that only one of two documents has parts two of its own neighbours and one of the other's. Up to k
    shingles the sketch is the whole set and the bound is certain, also where the other document has more than k. Above,
    each of the union's k smallest values is shared with odds of the threshold at least.
    """
    whole = F.least(F.ceil(n * (2 * threshold - 1) + 1 - 1e-9), k - F.floor(2 * n * (1 / threshold - 1) + 1e-9))
    return F.greatest(F.lit(1), F.when(n <= k, whole).otherwise(least_runs(threshold, k))).cast("int")


def sizes_fit(n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether two set sizes allow a similarity of ``percent``."""
    return F.least(n_a, n_b).cast("long") * 100 >= F.greatest(n_a, n_b).cast("long") * percent


def may_reach(a: Column, b: Column, n_a: Column, n_b: Column, percent: int, k: int = SKETCH) -> Column:
    """Whether sizes and the union sketch of two sorted sets allow a similarity of ``percent``.

    The union sketch holds the k smallest values of both; the share of them that both sets retain estimates the
    similarity.
    """
    top_a, top_b = F.slice(a, 1, k), F.slice(b, 1, k)
    union = F.slice(F.sort_array(F.array_union(top_a, top_b)), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(top_a, top_b), union))
    t = percent / 100
    least = t - SLACK * math.sqrt(t * (1 - t) / k)
    return sizes_fit(n_a, n_b, percent) & (shared >= F.size(union) * least)


def linked(a: Column, b: Column, percent: int) -> Column:
    """Exact test on full sets: 100 * intersection >= percent * union."""
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def prefix_postings(nodes: DataFrame, threshold: float, scratch: Scratch, k: int = SKETCH) -> DataFrame:
    """(value, node, n, shared): for every node the rarest of its sketch's neighbours that others have too.

    These values are ranked over the whole corpus by the number of nodes that have them. A value that only one node has
    generates nothing but takes its rank.
    """
    retained = nodes.select("node", F.explode(neighbours(F.col("sketch"), F.col("n"), k)).alias("value"))
    common = scratch.table(retained.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "common")
    met = meet(retained, ["value"], common, scratch)
    per_node = met.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("values"))
    ranked = per_node.join(nodes.select("node", "n", F.when(F.col("n") <= k, F.col("n") + 1).otherwise(k).alias("s")), "node")
    alone = F.col("s") - F.size("values")
    room = F.greatest(F.lit(0), F.col("s") - needed_overlap(F.col("n"), threshold, k) + 1 - alone)
    rows = ranked.select("node", "n", F.size("values").alias("shared"), F.explode(F.slice("values", F.lit(1), room)).alias("v"))
    posted = scratch.table(rows.select(F.col("v.value").alias("value"), "node", "n", "shared"), "postings")
    scratch.drop(common)
    return posted


def list_hubs(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, hub, hub_n, node, n) for the members of every list of two or more, but the hub itself."""
    hubs = postings.groupBy("value").agg(F.max_by(F.struct("node", "n"), F.struct("shared", "node")).alias("hub"), F.count("*").alias("rows")).filter("rows > 1")
    hubs = scratch.table(hubs.select("value", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    out = scratch.table(postings.join(hubs, "value").filter("node <> hub").select("value", "hub", "hub_n", "node", "n"), "posted")
    scratch.drop(hubs)
    return out


def by_node(pairs: DataFrame) -> DataFrame:
    """(node, hubs, is_hub) for every node of the pairs (hub, node): the hubs it is to be compared with, and whether it is one."""
    sides = pairs.select("node", "hub", F.lit(False).alias("is_hub")).unionByName(pairs.select(F.col("hub").alias("node"), F.lit(None).cast("long").alias("hub"), F.lit(True).alias("is_hub")))
    return sides.groupBy("node").agg(F.collect_set("hub").alias("hubs"), F.bool_or("is_hub").alias("is_hub"))


def hub_pairs(posted: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, node) of the members whose size and sketch allow them to be as similar to their hub as asked."""
    near = posted.filter(sizes_fit(F.col("n"), F.col("hub_n"), percent))
    pairs = scratch.table(by_node(near.select("hub", "node").distinct()), "pairs")
    sketches = scratch.table(meet(nodes, ["node"], pairs, scratch), "sketches")
    members = sketches.select("node", F.explode("hubs").alias("hub"), F.col("n").alias("n_a"), F.col("sketch").alias("a"))
    of_hubs = sketches.filter("is_hub").select(F.col("node").alias("hub"), F.col("n").alias("n_b"), F.col("sketch").alias("b"))
    both = members.join(of_hubs, "hub")
    out = scratch.table(both.filter(may_reach(F.col("a"), F.col("b"), F.col("n_a"), F.col("n_b"), percent)).select("hub", "node"), "dense")
    scratch.drop(pairs, sketches)
    return out


def collider_pairs(posted: DataFrame, dense: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, node) pairs to test exactly, of members that lie far from their list's hub and the rest of their list.

    Colliders and members of a list meet in blocks. Those without a partner of fitting size outside their own
    dense clusters go first; the sketches of the rest are then compared inside the join, which lets only likely pairs out.
    """
    named = posted.join(dense.withColumn("dense", F.lit(True)), ["hub", "node"], "left").select("value", "node", "n", F.col("dense").isNull().alias("stray"))
    named = scratch.table(named, "listed")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_DOCS).cast("int")
    shape = named.groupBy("value").agg(F.count("*").alias("rows"), F.count_if("stray").alias("far")).filter("rows > 1 AND far > 0")
    shape = scratch.table(shape.select("value", blocks("rows").alias("blocks"), blocks("far").alias("stray_blocks")), "far-lists")
    homes = dense.unionByName(dense.select("hub", F.col("hub").alias("node"))).groupBy("node").agg(F.collect_set("hub").alias("homes"))
    at_home = named.join(shape, "value").join(scratch.table(homes, "homes"), "node", "left").withColumn("homes", F.coalesce("homes", F.array().cast("array<bigint>")))
    rows = scratch.table(_blocked(at_home, ["value", "node", "n", "homes"]), "blocks")
    key = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("value", "i", "j")]
    apart = (F.col("x.node") != F.col("y.node")) & sizes_fit(F.col("x.n"), F.col("y.n"), percent) & ~F.arrays_overlap("x.homes", "y.homes")
    on = functools.reduce(operator.and_, [*key, apart])
    strays, members = rows.filter("stray"), rows.filter("NOT stray")
    strays = scratch.table(strays.alias("x").join(members.alias("y"), on, "left_semi"), "strays")
    members = scratch.table(members.alias("x").join(strays.alias("y"), on, "left_semi"), "members")
    left = scratch.table(strays.select("node").unionByName(members.select("node")).distinct(), "left")
    sketches = scratch.table(meet(nodes.select("node", "sketch"), ["node"], left, scratch), "sketches")
    sketched = lambda df: df.join(sketches, "node")
    likely = may_reach(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"), percent)
    found = sketched(strays).alias("x").join(sketched(members).alias("y"), on & likely)
    out = scratch.table(found.select(F.least("x.node", "y.node").alias("hub"), F.greatest("x.node", "y.node").alias("node")).distinct(), "collider-pairs")
    scratch.drop(named, shape, rows, strays, members, left, sketches)
    return out


def _blocked(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (stray, blocks, stray_blocks) dealt to block pairs (i, j): each member meets each stray in one of them."""
    spread = lambda name, of: F.pmod(F.xxhash64(F.lit(name), "node"), F.col(of)).cast("int")
    count = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    members = rows.select(*keep, F.lit(False).alias("stray"), spread("member", "blocks").alias("i"), count("stray_blocks").alias("j"))
    strays = rows.filter("stray").select(*keep, F.lit(True).alias("stray"), count("blocks").alias("i"), spread("stray", "stray_blocks").alias("j"))
    return members.unionByName(strays)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the hubs and nodes that are linked on their full sets (node, hubs, is_hub, shingles)."""
    members = sets.select("node", F.explode("hubs").alias("hub"), F.col("shingles").alias("a"))
    both = members.join(sets.filter("is_hub").select(F.col("node").alias("hub"), F.col("shingles").alias("b")), "hub")
    return both.filter(linked(F.col("a"), F.col("b"), percent)).select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _block_links(percent: int):
    """Links between the strays and the members of one block pair, by counting each stray's values among the members'."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, strays = pdf[~pdf.stray], pdf[pdf.stray]
        found: list[tuple[int, int]] = []
        if len(members) and len(strays):
            sizes = members.shingles.map(len).to_numpy()
            values = np.concatenate(members.shingles.to_list())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids, components = members.node.to_numpy(), members.component.to_numpy()
            for node, component, own in zip(strays.node, strays.component, strays.shingles):
                at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                both = np.add.reduceat((np.asarray(own)[at] == values).astype(np.int64), starts)
                hit = (both * 100 >= (sizes + len(own) - both) * percent) & (components != component) & (ids != node)
                found += [(node, x) for x in ids[hit]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _links_of_strays(clusters: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links that the hubs' own tests leave open: documents outside their hub's component against all of the cluster."""
    whole = clusters.unionByName(clusters.select("hub", F.col("hub").alias("node")).distinct())
    named = whole.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = scratch.table(named, "named")
    of_hub = named.filter("hub = node").select("hub", F.col("component").alias("hub_component"))
    marked = named.join(of_hub, "hub").withColumn("stray", F.col("component") != F.col("hub_component"))
    marked = scratch.table(marked.select("hub", "node", "component", "stray"), "marked")
    sizes = sets.select("node", F.size("shingles").alias("n"))
    shape = marked.join(sizes, "node").groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.ceil(F.sum(F.when(F.col("stray"), F.col("n")).otherwise(0)) / BLOCK_SHINGLES).cast("int").alias("stray_blocks"))
    shape = scratch.table(shape.filter("stray_blocks > 0"), "shape")
    told = marked.join(shape, "hub").groupBy("node", "component").agg(F.collect_list(F.struct("hub", "stray", "blocks", "stray_blocks")).alias("of"))
    told = scratch.table(told, "told")
    # Only sets of clusters with strays are read on, once, and dealt from where they are.
    rows = meet(sets.select("node", "shingles"), ["node"], told, scratch).select("node", "component", "shingles", F.inline("of"))
    rows = _blocked(rows, ["hub", "node", "component", "shingles"])
    return scratch.table(rows.groupBy("hub", "i", "j").applyInPandas(_block_links(percent), "a long, b long").distinct(), "stray_links")


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents with equal word sequences form one class, tested once, under its smallest doc_id; links between classes are
    confirmed on their full sets. component_id is the smallest doc_id reachable. Null, empty and blank texts have
    no shingles and are linked with nothing; repeated rows share a class. Rows with a null id are linked like others; where
    a component has no id but null it is null and its rows are kept, else they are not. Very long texts are shingled whole. An
    empty table gives none.
    """
    words = docs.select(F.col("doc_id").cast("long"), words_of(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    keyed = words.select("doc_id", F.md5(F.array_join("words", " ")).alias("class"), shingle_set(F.col("words"), width).alias("shingles"))
    rows = scratch.table(keyed.select("doc_id", "class", F.size("shingles").alias("n"), F.slice("shingles", 1, k).alias("sketch")), "rows")
    filled = rows.filter("n > 0")
    classes = filled.groupBy("class").agg(F.min("doc_id").alias("first_id"))
    # Numbered as written, so an executor's loss can't renumber them.
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    first = (filled.alias("r").join(classes.alias("c"), (F.col("r.class") == F.col("c.class")) & F.col("r.doc_id").eqNullSafe(F.col("c.first_id"))).select("c.node", "r.n", "r.sketch"))
    nodes = scratch.table(first, "nodes")
    repeated = nodes.count() > classes.count()
    if repeated:
        # Rows with the id and the words of an earlier one.
        every, nodes = nodes, scratch.table(nodes.dropDuplicates(["node"]), "nodes")
        scratch.drop(every)
    postings = prefix_postings(nodes, percent / 100, scratch, k)
    posted = list_hubs(postings, scratch)
    scratch.drop(postings)
    clusters = hub_pairs(posted, nodes, percent, scratch)
    apart = collider_pairs(posted, clusters, nodes, percent, scratch)
    scratch.drop(posted, nodes)
    # Full sets are made again from the texts, for the few documents that are in a pair.
    inside = scratch.table(by_node(clusters.unionByName(apart)), "inside")
    # A class without an id goes by its words.
    named_by = lambda id_, words_md5: F.coalesce(id_, F.xxhash64(words_md5))
    wanted = meet(classes, ["node"], inside, scratch).select("node", "hubs", "is_hub", "class", named_by(F.col("first_id"), F.col("class")).alias("name"))
    wanted = scratch.table(wanted, "wanted")
    # The ids go to the texts while they are few enough to broadcast; beyond that, a filter leaves few other texts to shuffle.
    own_words = F.md5(F.array_join(words_of(F.coalesce(F.col("text"), F.lit(""))), " "))
    texts = meet(docs.select(named_by(F.col("doc_id").cast("long"), own_words).alias("name"), "text"), ["name"], wanted, scratch)
    again = texts.select("node", "hubs", "is_hub", "class", words_of(F.coalesce(F.col("text"), F.lit(""))).alias("words")).filter(F.md5(F.array_join("words", " ")) == F.col("class"))
    full = again.select("node", "hubs", "is_hub", shingle_set(F.col("words"), width).alias("shingles"))
    sets = scratch.table(full.dropDuplicates(["node"]) if repeated else full, "sets")
    links = scratch.table(_links(sets, percent), "links")
    labels = scratch.table(connected_components(links, scratch), "labels")
    more = _links_of_strays(clusters, labels, sets, percent, scratch)
    if not more.isEmpty():
        # Components so far stand for their members.
        own = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        lifted = more.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        merged = scratch.table(connected_components(lifted, scratch), "merged")
        nodes_now = labels.unionByName(merged.select("node", F.col("node").alias("component")).join(labels.select("node"), "node", "left_anti"))
        joined = nodes_now.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
        labels = scratch.table(joined.select("node", F.coalesce("top", "component").alias("component")), "labels")
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = scratch.table(named.select("class", "first_id", "component"), "named")
    tops = scratch.table(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "tops")
    final = scratch.table(named.join(tops, "component").select("class", "component_id"), "final")
    # Rows without words share no class: joining them would put them all into one task.
    with_words = rows.filter("n > 0").join(final, "class", "left").select("doc_id", "n", "component_id")
    out = with_words.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on 2-word shingles at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "near"), width=2, percent=80)


OP2_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) >= 2 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) WHEN len(words) = 1 THEN words ELSE [] END AS g FROM t),
x AS MATERIALIZED (SELECT doc_id, unnest(g) AS v, len(g) AS n FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
