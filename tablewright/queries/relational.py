"""Sources and sinks, projections, joins, aggregations, windows, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import exprs as E
from tablewright.functions import user as U
from tablewright.operators import aggregates as A
from tablewright.operators import joins as J
from tablewright.operators import sets as S
from tablewright.operators import windows as W
from tablewright.plans.scratch import Scratch
from tablewright.plans.steps import compare, neutralize_join, with_total
from tablewright.queries.registry import query, table
from tablewright.sources import incremental as N
from tablewright.sources import io as IO


# 2.1 Sources and sinks


@query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS nations, min(n_name) AS first_name FROM nation GROUP BY 1")
def io1_read_seed(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "seed").path("nation")
    table(spark, d, "nation").write.option("header", True).csv(path)
    seed = IO.read_seed(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    return seed.groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.min("n_name").alias("first_name"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1")
def io2_read_external(spark: SparkSession, d: str) -> DataFrame:
    return IO.read_external(spark, d + "/{identifier}.parquet", "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@query("SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1")
def io3_materialize(spark: SparkSession, d: str) -> DataFrame:
    staged = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))
    IO.materialize(staged, "stg_orders")
    stored = IO.materialize(spark.table("stg_orders"), "stored_orders", "table", Scratch(spark, "tables").path("stored_orders"))
    return stored.groupBy("status").agg(F.count("*").alias("orders"))


@query("SELECT o_orderkey, o_orderstatus, round(CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 1.1 ELSE o_totalprice END, 4) AS o_totalprice FROM orders")
def io4_upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = orders.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 1.1)
    return IO.upsert(orders, changes, "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 4))


def customers_v2(customers: DataFrame) -> DataFrame:
    """A later version: a tenth of the keys is gone, a seventh changed, and five are new."""
    kept = customers.filter("c_custkey % 10 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    new = customers.sparkSession.range(1, 6).select((F.col("id") + 1_000_000_000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return kept.select("c_custkey", "c_mktsegment").unionByName(new)


V2_SQL = """v2 AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 0
        UNION ALL SELECT 1000000000 + i, 'NEW' FROM range(1, 6) r(i))"""


@query(f"""WITH {V2_SQL}, j AS (SELECT a.c_custkey AS ak, a.c_mktsegment AS a, b.c_custkey AS bk, b.c_mktsegment AS b FROM customer a FULL JOIN v2 b ON a.c_custkey = b.c_custkey)
SELECT ak AS c_custkey, a AS c_mktsegment, '2024-01-01' AS valid_from, CASE WHEN bk IS NOT NULL AND a IS NOT DISTINCT FROM b THEN NULL ELSE '2024-02-01' END AS valid_to FROM j WHERE ak IS NOT NULL
UNION ALL SELECT bk, b, '2024-02-01', NULL FROM j WHERE ak IS NULL OR (bk IS NOT NULL AND a IS DISTINCT FROM b)""")
def io5_snapshot_scd2(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    history = customers.withColumns({"valid_from": F.lit("2024-01-01"), "valid_to": F.lit(None).cast("string")})
    return IO.snapshot_scd2(history, customers_v2(customers), "c_custkey", ["c_mktsegment"], F.lit("2024-02-01"))


@query("SELECT r_name, CAST(count(*) AS BIGINT) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def io6_export_dated_parquet(spark: SparkSession, d: str) -> DataFrame:
    rollup = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"))
    return spark.read.parquet(IO.export_dated_parquet(rollup, Scratch(spark, "export").path("out"), "region_summary", "2024-01-31"))


@query("""SELECT 'csv' AS fmt, s_suppkey || ',' || CASE WHEN s_name || ', ' || s_nationkey LIKE '%,%' THEN '"' || s_name || ', ' || s_nationkey || '"' END AS line FROM supplier
UNION ALL SELECT 'tsv', s_suppkey || chr(9) || s_name || ' x' FROM supplier UNION ALL SELECT 'csv', 's_suppkey,n' UNION ALL SELECT 'tsv', 's_suppkey' || chr(9) || 'n'""")
def io7_export_delimited(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    csv = IO.export_delimited(s.select("s_suppkey", F.concat("s_name", F.lit(", "), F.col("s_nationkey").cast("string")).alias("n")), "csv").select(F.lit("csv").alias("fmt"), "line")
    tsv = IO.export_delimited(s.select("s_suppkey", F.concat("s_name", F.lit("\tx")).alias("n")), "tsv").select(F.lit("tsv").alias("fmt"), "line")
    return csv.unionByName(tsv)


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' | ' || 'a\\|b' || ' |' AS line FROM region UNION ALL SELECT '| r_regionkey | r_name | note |' UNION ALL SELECT '| --- | --- | --- |'")
def io8_export_markdown(spark: SparkSession, d: str) -> DataFrame:
    return IO.export_markdown(table(spark, d, "region").select("r_regionkey", "r_name", F.lit("a|b").alias("note")))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def io9_export_json(spark: SparkSession, d: str) -> DataFrame:
    return IO.export_json(table(spark, d, "nation"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 500")
def io10_preview(spark: SparkSession, d: str) -> DataFrame:
    return IO.preview(table(spark, d, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"), 500)


def orders_by_month(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, year(o_orderdate) * 100 + month(o_orderdate) AS month FROM orders), m AS (SELECT max(month) AS last FROM o)
SELECT o_orderkey, o_orderstatus, round(CASE WHEN o_orderkey % 5 = 0 AND month >= last - 1 THEN o_totalprice * 1.1 ELSE o_totalprice END, 4) AS o_totalprice,
       CAST(CASE WHEN o_orderkey % 10 = 0 AND month >= last - 1 THEN last + 1 ELSE month END AS INTEGER) AS month FROM o, m
UNION ALL SELECT 1000000000 + i, 'N', 1.5, CAST(last AS INTEGER) FROM m, range(3) r(i)""")
def io11_partitioned_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders in folders by month; in the last months a fifth change their price, half of those move to another month, and three are new."""
    path = Scratch(spark, "orders").path("by_month")
    N.write_partitioned(orders_by_month(spark, d), path, ["month"])
    stored = spark.read.parquet(path)
    last = F.broadcast(stored.agg(F.max("month").alias("last")))
    changed = stored.crossJoin(last).filter("o_orderkey % 5 = 0 AND month >= last - 1").withColumn("o_totalprice", F.col("o_totalprice") * 1.1)
    changed = changed.withColumn("month", F.when(F.col("o_orderkey") % 10 == 0, F.col("last") + 1).otherwise(F.col("month"))).drop("last")
    new = spark.range(3).crossJoin(last).select((F.col("id") + 1_000_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"), F.col("last").alias("month"))
    N.upsert_partitioned(path, changed.unionByName(new.select(*changed.columns)), "o_orderkey", ["month"])
    return spark.read.parquet(path).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_nationkey IN (3, 7) AND c_custkey % 10 = 0 AS gone, c_nationkey IN (3, 7) AND c_custkey % 10 <> 0 AND c_custkey % 7 = 0 AS changed FROM customer)
SELECT c_custkey, c_mktsegment, c_nationkey, '2024-01-01' AS valid_from, CASE WHEN gone OR changed THEN '2024-02-01' ELSE 'open' END AS valid_to FROM c
UNION ALL SELECT c_custkey, 'CHANGED', c_nationkey, '2024-02-01', '2024-03-01' FROM c WHERE changed
UNION ALL SELECT c_custkey, c_mktsegment, c_nationkey, '2024-03-01', 'open' FROM c WHERE changed OR gone
UNION ALL SELECT 1000000000 + i, 'NEW', 3, '2024-02-01', '2024-03-01' FROM range(5) r(i)""")
def io12_partitioned_history(spark: SparkSession, d: str) -> DataFrame:
    """Customers in folders by end of validity and nation: two nations change in February and change back in March."""
    path = Scratch(spark, "customers").path("history")
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    N.write_partitioned(customers.withColumns({"valid_from": F.lit("2024-01-01"), "valid_to": F.lit(N.OPEN)}), path, ["valid_to", "c_nationkey"])
    two = F.col("c_nationkey").isin(3, 7)
    later = customers.filter(~two | (F.col("c_custkey") % 10 != 0)).withColumn("c_mktsegment", F.when(two & (F.col("c_custkey") % 7 == 0), "CHANGED").otherwise(F.col("c_mktsegment")))
    new = spark.range(5).select((F.col("id") + 1_000_000_000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(3).alias("c_nationkey"))
    for version, as_of in ((later.unionByName(new), "2024-02-01"), (customers, "2024-03-01")):
        N.snapshot_partitioned(path, version, "c_custkey", ["c_mktsegment"], "c_nationkey", as_of)
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month FROM orders WHERE o_orderstatus = 'F'")
def io13_full_refresh(spark: SparkSession, d: str) -> DataFrame:
    """An incremental model built afresh: what its query gives now is all that stays."""
    path = Scratch(spark, "orders").path("by_month")
    orders = orders_by_month(spark, d)
    N.write_partitioned(orders, path, ["month"])
    N.upsert_partitioned(path, orders.filter("o_orderstatus = 'F'"), "o_orderkey", ["month"], full_refresh=True)
    return spark.read.parquet(path)


# 2.2 Projections and predicates


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS status FROM orders")
def pf1_rename_stage(spark: SparkSession, d: str) -> DataFrame:
    return stg_orders(table(spark, d, "orders"))


def stg_orders(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code, o_orderstatus IN ('O', 'P') AS is_open FROM orders")
def pf2_case_mapping(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", code.alias("code"), F.col("o_orderstatus").isin("O", "P").alias("is_open"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS reduction, round(l_extendedprice - round(l_extendedprice * l_discount, 4), 4) AS net FROM lineitem")
def pf3_lateral_alias(spark: SparkSession, d: str) -> DataFrame:
    priced = table(spark, d, "lineitem").withColumn("reduction", F.round(F.col("l_extendedprice") * F.col("l_discount"), 4))
    return priced.withColumn("net", F.round(F.col("l_extendedprice") - F.col("reduction"), 4)).select("l_orderkey", "l_linenumber", "reduction", "net")


@query("SELECT l_orderkey, l_linenumber, net FROM (SELECT *, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem) WHERE net > 10000")
def pf4_filter_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).filter("net > 10000").select("l_orderkey", "l_linenumber", "net")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND lower(o_orderpriority) LIKE '%urgent%'")
def pf5_filter_dsl(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return orders.filter(E.filter_dsl(orders, "o_totalprice: >200,000")).filter(E.filter_dsl(orders, "o_orderpriority: contains URGENT"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%building%' OR lower(c_name) LIKE '%building%'")
def pf6_search_all(spark: SparkSession, d: str) -> DataFrame:
    return E.search_all(table(spark, d, "customer"), "Building").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def pf7_predicate_tails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(E.tail("and", E.completed(F.col("o_orderstatus"), ["F"]), E.recent(F.col("o_orderdate"), "1996-01-01"))).select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR trim(p_type) = '' THEN NULL ELSE trim(p_type) END AS p_type,
CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'other' END AS bucket FROM part""")
def pf8_clean_string(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 5 == 0, " null ").otherwise(F.concat(F.lit("  "), "p_type"))
    size = F.when(F.col("p_size") < 10, "S").when(F.col("p_size") < 30, "M").otherwise("L")
    return table(spark, d, "part").select("p_partkey", E.clean_string(raw).alias("p_type"), E.status_bucket(size, {"s": "small", "m": "medium"}).alias("bucket"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-18'")
def pf9_date_floor(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "EEE MMM d yyyy").alias("text"))
    return text.select("o_orderkey", E.parse_us_date(F.col("text")).alias("day")).filter(F.col("day") <= F.lit("1995-06-17").cast("date"))


@query("SELECT max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O'")
def pf10_eval_expression(spark: SparkSession, d: str) -> DataFrame:
    return E.eval_expression(table(spark, d, "orders").filter("o_orderstatus = 'O'"), "max(o_totalprice)")


# 2.3 Joins


@query("SELECT c_custkey, CAST(coalesce(count(o_orderkey), 0) AS BIGINT) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1")
def j1_left_join_aggregate(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    out = J.join_aggregates(table(spark, d, "customer").select("c_custkey"), [stats], "c_custkey", ["orders", "spent"])
    return out.withColumn("spent", F.round("spent", 2))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus")
def j2_inner_join_keys(spark: SparkSession, d: str) -> DataFrame:
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == F.col("o_orderstatus"))
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), on).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT n_nationkey, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, coalesce(rich, 0) AS rich FROM nation
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a ON n_nationkey = a.k LEFT JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON n_nationkey = b.k
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c ON n_nationkey = c.k
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) e ON n_nationkey = e.k LEFT JOIN (SELECT c_nationkey AS k, count(*) AS rich FROM customer WHERE c_acctbal > 5000 GROUP BY 1) f ON n_nationkey = f.k""")
def j3_star_join(spark: SparkSession, d: str) -> DataFrame:
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    n = lambda df, key, name: df.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name))
    orders = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    parts = [n(customer, "c_nationkey", "customers"), n(supplier, "s_nationkey", "suppliers"), n(orders, "c_nationkey", "orders"), n(lines, "s_nationkey", "lines"), n(customer.filter("c_acctbal > 5000"), "c_nationkey", "rich")]
    return J.join_aggregates(table(spark, d, "nation").select("n_nationkey"), parts, "n_nationkey", ["customers", "suppliers", "orders", "lines", "rich"])


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT n_name, CAST(count(*) AS BIGINT) AS lines FROM nation JOIN f ON n_nationkey = a OR n_nationkey = b GROUP BY 1""")
def j4_or_join(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = J.join_either(table(spark, d, "nation"), facts.select("l_orderkey", "l_linenumber", "c_nationkey", "s_nationkey"), "n_nationkey", ["c_nationkey", "s_nationkey"])
    return joined.groupBy("n_name").agg(F.count("*").alias("lines"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linestatus = CASE WHEN l_returnflag = 'N' THEN 'O' ELSE o_orderstatus END GROUP BY 1")
def j5_case_join(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.when(F.col("l_returnflag") == "N", "O").otherwise(F.col("o_orderstatus"))
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_linestatus") == wanted)
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), on).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def j6_ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    return J.ordered_pairs(table(spark, d, "nation"), "n_nationkey", "n_regionkey")


@query("SELECT o_orderkey, round(o_totalprice - m.mean, 4) AS above FROM orders, (SELECT avg(o_totalprice) AS mean FROM orders) m")
def j7_one_row_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    mean = orders.agg(F.avg("o_totalprice").alias("mean"))
    return orders.crossJoin(F.broadcast(mean)).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("mean"), 4).alias("above"))


CUTOFF_SQL = """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, event_id AS cutoff FROM p WHERE k = 4)
SELECT e.event_id, e.user_id, e.event_type FROM events e LEFT JOIN c ON e.user_id = c.user_id WHERE c.cutoff IS NULL OR e.event_id <= c.cutoff"""


@query(CUTOFF_SQL)
def j8_range_self_join(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    hits = events.filter("event_type = 'purchase'").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("k = 4").select("user_id", F.col("event_id").alias("cutoff"))
    return events.join(hits, "user_id", "left").filter("cutoff IS NULL OR event_id <= cutoff").select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j9_join_latest(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.join_to_latest(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_orderdate", ["o_orderkey", "o_totalprice"])


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), tied AS (SELECT n FROM n GROUP BY 1 HAVING count(*) > 1)
SELECT event_id, e.user_id FROM events e JOIN n ON e.user_id = n.user_id WHERE n.n IN (SELECT n FROM tied)""")
def j10_correlated_in(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    n = events.groupBy("user_id").agg(F.count("*").alias("n"))
    tied = n.groupBy("n").agg(F.count("*").alias("users")).filter("users > 1")
    return events.join(n.join(tied, "n", "left_semi"), "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j11_anti_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON c_nationkey = s_nationkey""")
def j12_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer").fillna(0, ["customers", "suppliers"])


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS c_mktsegment FROM orders")
def j13_neutralize_join(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    return neutralize_join(table(spark, d, "orders"), customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("""SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, CAST(count(*) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def j14_pair_key(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = J.pair_key(F.col("c_nationkey"), F.col("s_nationkey"))
    return facts.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("lines"))


# 2.4 Aggregations


@query("SELECT o_custkey, min(o_totalprice) AS least, max(o_totalprice) AS most, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a1_basic_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS returned, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS open_lines FROM lineitem GROUP BY 1")
def a2_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open_lines"))


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS spent FROM events GROUP BY 1")
def a3_conditional_sums(spark: SparkSession, d: str) -> DataFrame:
    buys = F.col("event_type") == "purchase"
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(buys, 1).otherwise(0)).alias("purchases"), F.round(F.sum(F.when(buys, F.col("value")).otherwise(0)), 4).alias("spent"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def a4_group_by_all(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL", orders=table(spark, d, "orders"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def a5_grouping_as_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT c_mktsegment, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.05), 4) AS low, round(quantile_cont(o_totalprice, 0.95), 4) AS high FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def a6_interval_summary(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.interval_summary(joined, ["c_mktsegment"], "o_totalprice", Scratch(spark, "intervals")).select("c_mktsegment", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def a7_latest_value(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_value(table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderdate", "o_orderkey"])


@query("SELECT event_id, user_id, event_type FROM events e JOIN (SELECT user_id AS u, max(ts) AS m FROM events GROUP BY 1) ON user_id = u AND ts = m")
def a8_latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_rows(table(spark, d, "events"), "user_id", "ts").select("event_id", "user_id", "event_type")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS priorities, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 4")
def a9_having_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("priorities"), F.count("*").alias("orders")).filter("priorities >= 4")


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a10_ordered_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(A.ordered_text("n_name", "n_nationkey").alias("nations"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM documents WHERE n_chars < 0 HAVING count(*) = 0")
def a11_nothing_found(spark: SparkSession, d: str) -> DataFrame:
    return A.nothing_found(table(spark, d, "documents"), F.col("n_chars") < 0)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, round(sum({c}), 2) AS total, round(avg({c}), 6) AS mean FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def a12_selection_summary(spark: SparkSession, d: str) -> DataFrame:
    out = A.selection_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", "n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


# 2.5 Windows


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_last FROM orders""")
def w1_first_last(spark: SparkSession, d: str) -> DataFrame:
    return W.first_last_flags(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "is_first", "is_last")


@query("SELECT o_orderkey, CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS previous FROM orders")
def w2_lag(spark: SparkSession, d: str) -> DataFrame:
    return W.with_previous(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", "previous").select("o_orderkey", F.col("previous").cast("date").alias("previous"))


@query("""WITH s AS (SELECT c_custkey, c_mktsegment, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT *, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY spent DESC) AS INTEGER) AS place FROM s""")
def w3_rank(spark: SparkSession, d: str) -> DataFrame:
    spent = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_mktsegment").agg(F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0)), 2).alias("spent"))
    return W.ranked_values(spent, "c_mktsegment", "spent", Scratch(spark, "ranks"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_orderkey - previous > 1")
def w4_rank_gaps(spark: SparkSession, d: str) -> DataFrame:
    return W.rank_gaps(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT p_partkey, p_name, CAST(count(*) OVER () AS BIGINT) AS total_rows FROM part ORDER BY p_partkey LIMIT 50")
def w5_sample_with_total(spark: SparkSession, d: str) -> DataFrame:
    return with_total(table(spark, d, "part").select("p_partkey", "p_name"), 50, "p_partkey")


@query(CUTOFF_SQL)
def w6_first_to_n(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return J.up_to_cutoff(events, "user_id", "event_id", F.col("event_type") == "purchase", 4)


@query("""SELECT s_suppkey, n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS seed,
'R' || n_regionkey || '-' || row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def w7_reseed(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "supplier").filter("s_acctbal > 0").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    slim = kept.select("s_suppkey", "n_regionkey", "s_acctbal")
    out = W.reseed(slim, "n_regionkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), Scratch(spark, "seeds"))
    return out.select("s_suppkey", "n_regionkey", "seed", "label")


# 2.6 Sort, limit, sets


@query("SELECT c_custkey, spent FROM (SELECT c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 GROUP BY 1) ORDER BY spent ASC NULLS LAST, c_custkey LIMIT 100")
def s1_sort_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    joined = table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left")
    return E.sort_nulls_last(joined, "spent", True, "c_custkey").limit(100)


@query("SELECT source AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def s2_top_values(spark: SparkSession, d: str) -> DataFrame:
    return S.top_values(table(spark, d, "documents"), "source")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def s3_union_all(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.union(table(spark, d, "supplier").select(F.lit("supplier"), "s_suppkey", "s_name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT -1, 'unknown', NULL")
def s4_unknown_row(spark: SparkSession, d: str) -> DataFrame:
    return S.with_unknown_row(table(spark, d, "nation"), n_nationkey=-1, n_name="unknown")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1")
def s5_generated_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "purchase")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 70 <> 0), o AS (SELECT o_orderkey, o_orderstatus FROM orders)
SELECT *, 'missing' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM x) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM o)""")
def s6_multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    other = orders.filter("o_orderkey % 70 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")))
    return compare(other, orders)


# 2.7 Scalar functions, 2.14 functions


@query("SELECT p_partkey, lower(p_name) || '/' || upper(trim(p_type)) AS label, substring(p_name, 1, 3) AS head, substring(p_brand, 7) AS brand_tail, p_type LIKE '%E%' AS has_e FROM part")
def f1_strings(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lower("p_name"), F.lit("/"), F.upper(F.trim("p_type")))
    return table(spark, d, "part").select("p_partkey", label.alias("label"), F.substring("p_name", 1, 3).alias("head"), F.col("p_brand").substr(F.lit(7), F.lit(1000)).alias("brand_tail"), F.col("p_type").like("%E%").alias("has_e"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
def f2_nulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"))


@query("SELECT l_orderkey, l_linenumber, round(abs(-l_extendedprice), 2) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS b, round(pow(l_quantity, 2), 4) AS c, round(ln(l_extendedprice + 1), 6) AS e, least(l_discount, l_tax) AS f, greatest(l_discount, l_tax) AS g FROM lineitem")
def f3_math(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.abs(-price), 2).alias("a"), F.floor(price).alias("b"), F.round(F.pow("l_quantity", F.lit(2)), 4).alias("c"), F.round(F.log(price + 1), 6).alias("e"), F.least("l_discount", "l_tax").alias("f"), F.greatest("l_discount", "l_tax").alias("g"))


@query("SELECT o_orderkey, CAST(o_orderkey / 2.0 AS INTEGER) AS half, try_cast(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority, try_cast(o_orderpriority AS INTEGER) AS bad, CAST(o_orderkey AS VARCHAR) AS t, CAST(o_orderdate AS DATE) AS day FROM orders")
def f4_casts(spark: SparkSession, d: str) -> DataFrame:
    half = E.int_round(F.col("o_orderkey") / 2.0)
    return table(spark, d, "orders").select("o_orderkey", half.alias("half"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority"), F.col("o_orderpriority").try_cast("int").alias("bad"), F.col("o_orderkey").cast("string").alias("t"), F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1995-01-01'")
def f5_dates(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.datediff("l_shipdate", "o_orderdate").alias("days"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f6_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_custkey - 5 AS VARCHAR) END AS INTEGER) > 0, false) AS flag FROM customer")
def u1_is_positive_int(spark: SparkSession, d: str) -> DataFrame:
    E.create_is_positive_int(spark)
    text = F.when(F.col("c_custkey") % 3 == 0, "x").otherwise((F.col("c_custkey") - 5).cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.call_function("is_positive_int", text).alias("flag"))


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice)) FILTER (l_extendedprice > 0)), 4) AS typical_price, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 8) AS discount FROM lineitem GROUP BY 1")
def u2_aggregate_functions(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(U.GEOMETRIC_MEAN(price), 4).alias("typical_price"), F.round(U.WEIGHTED_MEAN("l_discount", price), 8).alias("discount"))
