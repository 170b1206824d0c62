"""Lineage and graph queries, and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import graph as G
from tablewright.operators import reachability as A
from tablewright.operators import versions as V
from tablewright.plans.scratch import Scratch
from tablewright.queries.registry import query, table
from tablewright.queries.relational import V2_SQL, customers_v2
from tablewright.streaming import runlog as R

# 2.11 Lineage


def _id(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.concat_ws("-", *[F.col(c).cast("string") for c in columns]))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(parent, child) from region down to line, by customers and orders, by suppliers and by parts."""
    nation, customer, orders, line = (table(spark, d, n) for n in ("nation", "customer", "orders", "lineitem"))
    link = lambda df, a, b: df.select(a.alias("parent"), b.alias("child"))
    at = _id("l", "l_orderkey", "l_linenumber")
    parts = [
        link(nation, _id("r", "n_regionkey"), _id("n", "n_nationkey")), link(customer, _id("n", "c_nationkey"), _id("c", "c_custkey")), link(orders, _id("c", "o_custkey"), _id("o", "o_orderkey")), link(line, _id("o", "l_orderkey"), at),
        link(table(spark, d, "supplier"), _id("n", "s_nationkey"), _id("s", "s_suppkey")), link(line, _id("s", "l_suppkey"), at), link(line, _id("p", "l_partkey"), at),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES_SQL = """e AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 'r:' || n_regionkey AS parent, 'n:' || n_nationkey AS child FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders UNION ALL SELECT 'o:' || l_orderkey, 'l:' || l_orderkey || '-' || l_linenumber FROM lineitem
UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier UNION ALL SELECT 's:' || l_suppkey, 'l:' || l_orderkey || '-' || l_linenumber FROM lineitem UNION ALL SELECT 'p:' || l_partkey, 'l:' || l_orderkey || '-' || l_linenumber FROM lineitem))"""


def walk_sql(name: str, start: str, up: bool = False, depth: int = 10) -> str:
    """Recursive walk and its shortest distances as tables name_w and name."""
    a, b = ("child", "parent") if up else ("parent", "child")
    return f"""{name}_w AS (SELECT {start} AS id, 0 AS distance UNION SELECT e.{b}, w.distance + 1 FROM {name}_w w JOIN e ON e.{a} = w.id WHERE w.distance < {depth}),
{name} AS MATERIALIZED (SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM {name}_w GROUP BY 1 HAVING min(distance) > 0)"""


@query(f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('x', chr(39) + 'n:7' + chr(39))} SELECT * FROM x")
def g1_lineage(spark: SparkSession, d: str) -> DataFrame:
    return G.lineage(edges(spark, d), "n:7")


@query(f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('u', chr(39) + 'c:10' + chr(39), True)}, {walk_sql('x', chr(39) + 'c:10' + chr(39))} SELECT *, upstream + downstream AS total FROM (SELECT CAST(count(*) AS BIGINT) AS upstream FROM u), (SELECT CAST(count(*) AS BIGINT) AS downstream FROM x)")
def g2_both_directions(spark: SparkSession, d: str) -> DataFrame:
    return G.lineage_counts(edges(spark, d), "c:10")


def nodes(e: DataFrame) -> DataFrame:
    """(id, type) of all that edges name, as often as they do."""
    ids = e.select(F.col("parent").alias("id")).union(e.select("child"))
    return ids.withColumn("type", F.substring("id", 1, 1))


@query(f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('x', chr(39) + 'n:3' + chr(39), False, 100)}, t AS (SELECT id[1:1] AS type, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1), s AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM t) SELECT type, n, total, CASE WHEN total <= 3 THEN 'low' WHEN total <= 10 THEN 'medium' ELSE 'high' END AS level FROM t, s")
def g3_impact(spark: SparkSession, d: str) -> DataFrame:
    e = G.written(edges(spark, d), Scratch(spark, "impact"))
    return G.impact(e, nodes(e), "n:3")


@query(f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('x', chr(39) + 'r:1' + chr(39), False, 100)} SELECT distance, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id, max(id) AS last_id FROM x GROUP BY 1")
def g4_affected_by_distance(spark: SparkSession, d: str) -> DataFrame:
    return G.affected_by_distance(edges(spark, d), "r:1")


@query(f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('u', chr(39) + 'o:1' + chr(39), True)}, {walk_sql('x', chr(39) + 'o:1' + chr(39))} SELECT 'o:1' AS id, 0 AS level UNION ALL SELECT coalesce(u.id, x.id), CASE WHEN x.distance IS NULL OR u.distance <= x.distance THEN u.distance ELSE -x.distance END FROM u FULL JOIN x ON u.id = x.id")
def g5_signed_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.signed_levels(edges(spark, d), "o:1")


DIFF_SQL = f"""{V2_SQL}, df AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM customer a FULL JOIN v2 b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR md5('=' || a.c_mktsegment) <> md5('=' || b.c_mktsegment))"""


def customer_changes(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return G.version_diff(customers, customers_v2(customers), "c_custkey")


@query(f"WITH {DIFF_SQL} SELECT * FROM df")
def g6_version_diff(spark: SparkSession, d: str) -> DataFrame:
    return customer_changes(spark, d)


@query(f"""WITH {DIFF_SQL}, c AS (SELECT 'c:' || c_custkey AS id FROM df WHERE change = 'changed'), o AS (SELECT DISTINCT 'o:' || o_orderkey AS id FROM orders JOIN c ON c.id = 'c:' || o_custkey),
l AS (SELECT DISTINCT 'l:' || l_orderkey || '-' || l_linenumber AS id FROM lineitem JOIN o ON o.id = 'o:' || l_orderkey) SELECT id, 0 AS distance FROM c UNION ALL SELECT id, 1 FROM o UNION ALL SELECT id, 2 FROM l""")
def g7_invalidate(spark: SparkSession, d: str) -> DataFrame:
    changed = customer_changes(spark, d).filter("change = 'changed'").select(_id("c", "c_custkey").alias("id"))
    return G.invalidated(edges(spark, d), changed)


LAYERS = [("large", {"all": [{"name_regex": "^[A-Z]"}, {"folder": "parts/40"}]}), ("brand", {"any": [{"tag": "Brand#11"}, {"tag": "Brand#22"}], "materialized": "never"}), ("rest", {"materialized": "table", "name_prefix": ""}), ("none", {})]


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[A-Z]') AND p_size = 40 THEN 'large' WHEN p_brand IN ('Brand#11', 'Brand#22') THEN 'brand' WHEN p_partkey % 2 = 0 THEN 'rest' END AS layer FROM part""")
def g8_layers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 2 == 0, "table").otherwise("view")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat(F.lit("parts/"), F.col("p_size").cast("string")).alias("path"), F.array("p_brand").alias("tags"), kind.alias("materialized"))
    return G.classify_layers(parts, LAYERS).select("p_partkey", "layer")


@query("""WITH b AS (SELECT split_part(regexp_replace(url, '^https?://[^/]*/', ''), '/', 1) AS layer FROM pages), c AS (SELECT layer, CAST(count(*) AS BIGINT) AS n FROM b WHERE layer <> '' GROUP BY 1) SELECT layer, n FROM c WHERE (SELECT count(*) FROM c) BETWEEN 2 AND 8""")
def g9_suggest_by_folder(spark: SparkSession, d: str) -> DataFrame:
    part = F.split_part(F.regexp_replace("url", "^https?://[^/]*/", ""), F.lit("/"), F.lit(1))
    return G.suggest_by_folder(table(spark, d, "pages"), part)


@query("""WITH t AS (SELECT source AS tag, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1), r AS (SELECT * FROM t ORDER BY n DESC, tag LIMIT 5),
w AS (SELECT regexp_extract(p_name, '^([A-Za-z]+)[_ ]', 1) AS layer FROM part), x AS (SELECT layer, CAST(count(*) AS BIGINT) AS n FROM w WHERE layer <> '' GROUP BY 1 HAVING count(*) >= greatest(3, (SELECT count(*) FROM w) * 0.05) ORDER BY n DESC, layer LIMIT 6)
SELECT 'tag' AS kind, tag AS layer, n FROM r WHERE (SELECT sum(n) FROM r) >= (SELECT count(*) FROM documents) * 0.2 UNION ALL SELECT 'prefix', layer, n FROM x""")
def g10_suggest_by_tag_and_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tags = docs.groupBy(F.col("source").alias("tag")).agg(F.count("*").alias("n"))
    by_tag = G.suggest_by_tag(tags, docs.agg(F.count("*").alias("total")), ["staging", "marts"], 0.2)
    by_prefix = G.suggest_by_prefix(table(spark, d, "part").select(F.col("p_name").alias("name")))
    return by_tag.withColumn("kind", F.lit("tag")).unionByName(by_prefix.withColumn("kind", F.lit("prefix")))


@query("""WITH n AS (SELECT 'customer' AS type, c_mktsegment AS tag, 'nation/' || c_nationkey AS path, 'm' || c_custkey AS name FROM customer UNION ALL SELECT 'supplier', NULL, 'nation/' || s_nationkey, 'm' || s_suppkey FROM supplier UNION ALL SELECT 'part', p_brand, 'size/' || p_size, 'm' || p_partkey FROM part)
SELECT kind, value, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'type' AS kind, type AS value FROM n UNION ALL SELECT 'folder', path FROM n UNION ALL SELECT 'tag', tag FROM n WHERE tag IS NOT NULL) GROUP BY 1, 2
UNION ALL SELECT 'duplicate name', name, CAST(count(DISTINCT type) AS BIGINT) FROM n GROUP BY name HAVING count(DISTINCT type) > 1""")
def g11_inventory(spark: SparkSession, d: str) -> DataFrame:
    # A table stands for a package; its keys name the nodes.
    node = lambda name, key, tags, path: table(spark, d, name).select(F.lit(name).alias("type"), F.lit(name).alias("package"), F.concat(F.lit("m"), F.col(key).cast("string")).alias("name"), tags.alias("tags"), path.alias("path"))
    at = lambda prefix, c: F.concat(F.lit(f"{prefix}/"), F.col(c).cast("string"))
    all_nodes = node("customer", "c_custkey", F.array("c_mktsegment"), at("nation", "c_nationkey")).unionByName(node("supplier", "s_suppkey", F.array().cast("array<string>"), at("nation", "s_nationkey"))).unionByName(node("part", "p_partkey", F.array("p_brand"), at("size", "p_size")))
    return G.inventory(all_nodes)


def column_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between (relation, key) pairs."""
    e = edges(spark, d)
    return e.select(F.split_part("parent", F.lit(":"), F.lit(1)).alias("source_model"), F.split_part("parent", F.lit(":"), F.lit(2)).alias("source_column"), F.split_part("child", F.lit(":"), F.lit(1)).alias("target_model"), F.split_part("child", F.lit(":"), F.lit(2)).alias("target_column"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('x', '(SELECT min(child) FROM e WHERE child LIKE ' + chr(39) + 'l:1-%' + chr(39) + ')', True)} SELECT replace(id, ':', '.') AS id, distance FROM x")
def g12_column_lineage(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "lineitem").filter("l_orderkey = 1").agg(F.min(_id("l", "l_orderkey", "l_linenumber")).alias("id")).first()["id"]
    return G.column_lineage(column_edges(spark, d), "l", (first or "l:1-1")[2:])


@query("""SELECT DISTINCT lang AS model, source AS "column" FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels l ON x.doc_id = l.doc_id WHERE l.toxic = 1 AND x.lang = d.lang AND x.source = d.source) AND lang <> 'es'""")
def g13_unused_columns(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("model"), F.col("source").alias("column"))
    used = docs.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id").select(F.col("model").alias("source_model"), F.col("column").alias("source_column"))
    return G.unused_columns(docs.select("model", "column").distinct(), used, docs.select("model").distinct().filter("model = 'es'"))


@query(f"WITH {EDGES_SQL}, n AS (SELECT 'p:' || p_partkey AS id FROM part UNION ALL SELECT 's:' || s_suppkey FROM supplier) SELECT id, 'orphan' AS kind FROM n WHERE id NOT IN (SELECT child FROM e) UNION ALL SELECT id, 'leaf' FROM n WHERE id NOT IN (SELECT parent FROM e)")
def g14_orphans_and_leaves(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").select(_id("p", "p_partkey").alias("id")).union(table(spark, d, "supplier").select(_id("s", "s_suppkey")))
    return G.orphans_and_leaves(ids, edges(spark, d))


@query(f"WITH {DIFF_SQL} SELECT * FROM df")
def g15_diff_by_hash_tree(spark: SparkSession, d: str) -> DataFrame:
    """g6's rows from two stored versions, reading only ranges that differ."""
    scratch, customers = Scratch(spark, "versions"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    old, new = scratch.path("old"), scratch.path("new")
    V.store_version(customers, old, "c_custkey", 64)
    V.store_version(customers_v2(customers), new, "c_custkey", like=old)
    return V.stored_diff(spark, old, new, "c_custkey")


CHANGED_EDGES_SQL = f"""{EDGES_SQL.replace("e AS MATERIALIZED", "b AS MATERIALIZED")}, e AS MATERIALIZED (SELECT * FROM b WHERE NOT coalesce(parent LIKE 'c:%' AND TRY_CAST(child[3:] AS BIGINT) % 7 = 0 AND TRY_CAST(child[3:] AS BIGINT) % 14 <> 0, false)
  AND NOT coalesce(parent = 'n:7' AND child LIKE 's:%' AND TRY_CAST(child[3:] AS BIGINT) % 3 = 0, false) UNION SELECT 'n:7', 'o:' || o_orderkey FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey % 100 <> 0)"""


@query(f"WITH RECURSIVE {CHANGED_EDGES_SQL}, {walk_sql('x', chr(39) + 'n:7' + chr(39))} SELECT * FROM x")
def g16_incremental_reach(spark: SparkSession, d: str) -> DataFrame:
    """What depends on a nation, kept up to date over three batches of added and removed edges."""
    scratch = Scratch(spark, "batches")
    now = G.written(edges(spark, d), scratch)
    number = F.split_part("child", F.lit(":"), F.lit(2)).try_cast("long")
    to_orders = now.filter("parent LIKE 'c:%'")
    short = table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.lit("n:7").alias("parent"), _id("o", "o_orderkey").alias("child"))
    batches = [
        (now.limit(0), to_orders.filter(number % 7 == 0)), (to_orders.filter(number % 14 == 0).unionByName(short), now.limit(0)),
        (now.limit(0), short.filter(number % 100 == 0).unionByName(now.filter("parent = 'n:7' AND child LIKE 's:%'").filter(number % 3 == 0))),
    ]
    reached = G.lineage(now, "n:7").unionByName(spark.range(1).select(F.lit("n:7").alias("id"), F.lit(0).alias("distance")))
    for added, removed in [tuple(scratch.table(x, "batch") for x in b) for b in batches]:
        now = scratch.table(A.changed_edges(now, added, removed, scratch), "edges")
        reached = A.updated_reach(reached, now, added, removed, scratch)
    return reached.filter("distance > 0")


@query(f"WITH RECURSIVE {EDGES_SQL}, c AS (SELECT parent AS id, child AS dep FROM e UNION SELECT c.id, e.child FROM c JOIN e ON c.dep = e.parent), n AS (SELECT id, count(*) AS n FROM c GROUP BY 1), i AS (SELECT parent AS id FROM e UNION SELECT child FROM e) SELECT id, CAST(least(16, coalesce(n, 0)) AS BIGINT) AS reached, CASE WHEN coalesce(n, 0) <= 3 THEN 'low' WHEN n <= 10 THEN 'medium' ELSE 'high' END AS level FROM i LEFT JOIN n USING (id)")
def g17_impact_levels(spark: SparkSession, d: str) -> DataFrame:
    """The impact level of every node at once."""
    return A.impact_levels(edges(spark, d), Scratch(spark, "impact"))


def looping_edges(spark: SparkSession, d: str) -> DataFrame:
    """Chains of five customers, half of them closed to a ring of four, a third with a ring of two, and some loops."""
    k, i, g = F.col("c_custkey"), F.col("c_custkey") % 5, F.floor(F.col("c_custkey") / 5)
    to = F.array(F.when(i < 4, k + 1), F.when((i == 3) & (g % 2 == 0), k - 3), F.when((i == 2) & (g % 3 == 0), k - 1), F.when(k % 17 == 0, k))
    links = table(spark, d, "customer").select(k, F.explode(to).alias("to")).filter("to IS NOT NULL")
    return links.select(_id("c", "c_custkey").alias("parent"), _id("c", "to").alias("child"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT 'c:' || k AS parent, 'c:' || t AS child FROM (SELECT c_custkey AS k, unnest([CASE WHEN c_custkey % 5 < 4 THEN c_custkey + 1 END, CASE WHEN c_custkey % 5 = 3 AND c_custkey // 5 % 2 = 0 THEN c_custkey - 3 END,
  CASE WHEN c_custkey % 5 = 2 AND c_custkey // 5 % 3 = 0 THEN c_custkey - 1 END, CASE WHEN c_custkey % 17 = 0 THEN c_custkey END]) AS t FROM customer) WHERE t IS NOT NULL),
r AS (SELECT parent AS a, child AS b FROM e UNION SELECT r.a, e.child FROM r JOIN e ON r.b = e.parent), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT a AS node, min(b) AS component, CAST(count(*) AS BIGINT) AS size FROM m GROUP BY 1""")
def g18_cycles(spark: SparkSession, d: str) -> DataFrame:
    return A.cycles(looping_edges(spark, d), Scratch(spark, "cycles"))


# 2.12 Run logs


def run_logs(spark: SparkSession, d: str) -> DataFrame:
    """A log line per event, and lines that are no events."""
    events = table(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "error", "error").otherwise("fail")
    node = F.concat(F.lit("model.p."), F.col("user_id").cast("string"))
    info = F.struct(F.when(F.col("event_id") % 7 == 0, "LogTestResult").otherwise("NodeFinished").alias("name"), F.lit("done").alias("msg"))
    is_test = F.col("event_id") % 7 == 0
    data = F.struct(
        F.when(is_test, node).alias("name"), F.when(is_test, F.when(status == "success", "pass").otherwise(status)).alias("status"), F.when(is_test, (F.col("event_id") % 5).cast("int")).alias("num_failures"), F.when(is_test, F.col("value")).alias("elapsed_time"),
        F.when(~is_test, F.struct(node.alias("unique_id"), F.when(F.col("event_id") % 2 == 0, status).alias("node_status"), F.col("value").alias("execution_time"))).alias("node_info"),
        F.when(~is_test, F.struct(status.alias("status"), F.col("value").alias("execution_time"))).alias("run_result"),
    )
    lines = events.select(F.to_json(F.struct(info.alias("info"), data.alias("data"), F.col("event_id").alias("seq"))).alias("value"))
    noise = events.filter("event_id % 11 = 0").select(F.when(F.col("event_id") % 2 == 0, '{"success": true}').otherwise("Running with version 1").alias("value"))
    return lines.unionByName(noise)


RUN_SQL = """r AS (SELECT 'model.p.' || user_id AS unique_id, CASE event_type WHEN 'view' THEN 'success' WHEN 'signup' THEN 'skipped' WHEN 'purchase' THEN 'warn' ELSE 'error' END AS status, value AS seconds, event_id FROM events WHERE event_id % 7 <> 0),
x AS (SELECT unique_id, arg_max(status, event_id) AS status, arg_max(seconds, event_id) AS seconds FROM r GROUP BY 1)"""


@query(f"WITH {RUN_SQL} SELECT * FROM x")
def l1_run_results(spark: SparkSession, d: str) -> DataFrame:
    return R.run_results(run_logs(spark, d))


@query("""WITH r AS (SELECT 'model.p.' || user_id AS unique_id, CASE event_type WHEN 'view' THEN 'pass' WHEN 'signup' THEN 'skip' WHEN 'purchase' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'fail' END AS status, value AS seconds, event_id FROM events WHERE event_id % 7 = 0)
SELECT unique_id, arg_max(status, event_id) AS status, CAST(arg_max(event_id, event_id) % 5 AS INTEGER) AS failures, arg_max(seconds, event_id) AS seconds FROM r GROUP BY 1""")
def l2_test_results(spark: SparkSession, d: str) -> DataFrame:
    return R.test_results(run_logs(spark, d))


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'LogTestResult' ELSE 'NodeFinished' END AS name, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def l3_skip_malformed(spark: SparkSession, d: str) -> DataFrame:
    return R.parsed(run_logs(spark, d)).groupBy(F.col("info.name").alias("name")).agg(F.count("*").alias("n"))


@query(f"WITH {RUN_SQL} SELECT status, CAST(count(*) AS BIGINT) AS nodes, round(sum(seconds), 4) AS seconds, max(seconds) AS slowest FROM x GROUP BY 1")
def l4_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return R.roll_up(R.run_results(run_logs(spark, d)))


@query(f"WITH {RUN_SQL} SELECT * FROM x")
def l5_live_status(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "live")
    folder, changes = scratch.path("logs"), scratch.path("changes")
    run_logs(spark, d).write.text(folder)
    R.live_status(spark, folder, changes, scratch.path("checkpoint")).awaitTermination()
    return R.latest_status(spark, changes)


def timed_logs(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of nodes that begin with each event and finish ``value`` seconds later, clicks never, with the part of the month."""
    events = table(spark, d, "events")
    node = F.struct(F.concat(F.lit("model.p."), F.col("user_id").cast("string")).alias("unique_id"), F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "purchase", "warn").otherwise("error").alias("node_status"), F.col("value").alias("execution_time"))
    took = F.array(F.lit(0).cast("long"), F.when(F.col("event_type") != "click", F.round(F.col("value") * 1000).cast("long")))
    steps = events.select("event_id", node.alias("node"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.posexplode(took).alias("i", "took")).filter("took IS NOT NULL")
    at = F.timestamp_millis(F.col("ms") + F.col("took"))
    info = F.struct(F.when(F.col("i") == 0, "NodeStart").otherwise("NodeFinished").alias("name"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"))
    line = F.to_json(F.struct(info.alias("info"), F.struct(F.col("node").alias("node_info")).alias("data"), (F.col("event_id") * 2 + F.col("i")).alias("seq")))
    return steps.select(line.alias("value"), F.least(F.lit(2), F.floor((F.dayofmonth(at) - 1) / 10)).alias("part"))


@query("""WITH e AS (SELECT 'model.p.' || user_id AS unique_id, event_id, event_type, value, epoch_ms(ts) AS ms FROM events),
x AS (SELECT unique_id, 'running' AS status, NULL AS seconds, 2 * event_id AS seq, ms FROM e
      UNION ALL SELECT unique_id, CASE event_type WHEN 'view' THEN 'success' WHEN 'signup' THEN 'skipped' WHEN 'purchase' THEN 'warn' ELSE 'error' END, value, 2 * event_id + 1, ms + CAST(round(value * 1000) AS BIGINT) FROM e WHERE event_type <> 'click'),
l AS (SELECT unique_id, arg_max(status, seq) AS status, arg_max({'s': seconds}, seq)['s'] AS seconds, arg_max(ms, seq) AS ms FROM x GROUP BY 1)
SELECT unique_id, CASE WHEN status = 'running' AND ms + 3600000 <= (SELECT max(ms) - 60000 FROM x) THEN 'stuck' ELSE status END AS status, seconds FROM l""")
def l6_stuck_nodes(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "watch")
    folder, changes, checkpoint = scratch.path("logs"), scratch.path("changes"), scratch.path("checkpoint")
    logs = scratch.table(timed_logs(spark, d), "lines")
    for part in range(3):
        logs.filter(F.col("part") == part).select("value").write.mode("append").text(folder)
        R.live_status(spark, folder, changes, checkpoint, compact_every=3).awaitTermination()
    return R.latest_status(spark, changes)
