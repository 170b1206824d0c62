"""Data tests, step profiles and column profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.operators import datatests as T
from tablewright.operators import profile as C
from tablewright.operators import sketches as K
from tablewright.plans import steps as P
from tablewright.plans.scratch import Scratch
from tablewright.queries.registry import query, table
from tablewright.sources import io as IO

# 2.8 Data tests


@query("""SELECT 'not_null' AS test, 'customer_orders' AS model, 'o_orderkey' AS "column", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END AS status, CAST(count(*) AS BIGINT) AS failures
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL
UNION ALL SELECT 'not_null', 'orders', 'o_custkey', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey IS NULL""")
def t1_not_null(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    joined = table(spark, d, "customer").join(orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return T.not_null(joined, "customer_orders", "o_orderkey", "warn").unionByName(T.not_null(orders, "orders", "o_custkey"))


@query("""SELECT 'unique' AS test, 'lineitem' AS model, 'l_orderkey,l_linenumber' AS "column", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) AS BIGINT) AS failures
FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def t2_unique(spark: SparkSession, d: str) -> DataFrame:
    return T.unique(table(spark, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


@query("""SELECT 'accepted_values' AS test, 'orders' AS model, 'o_orderstatus' AS "column", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) AS BIGINT) AS failures FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def t3_accepted_values(spark: SparkSession, d: str) -> DataFrame:
    return T.accepted_values(table(spark, d, "orders"), "orders", "o_orderstatus", ["O", "F"])


@query("""SELECT 'relationships' AS test, 'lineitem' AS model, 'l_orderkey' AS "column", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) AS BIGINT) AS failures
FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""")
def t4_relationships(spark: SparkSession, d: str) -> DataFrame:
    return T.relationships(table(spark, d, "lineitem"), "lineitem", "l_orderkey", table(spark, d, "orders").filter("o_orderstatus <> 'P'"), "o_orderkey")


@query("""SELECT 'not_empty' AS test, 'documents' AS model, '' AS "column", CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS status, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS failures FROM documents
UNION ALL SELECT 'not_empty', 'negative_documents', '', CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM documents WHERE n_chars < 0""")
def t5_not_empty(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return T.not_empty(docs, "documents").unionByName(T.not_empty(docs.filter("n_chars < 0"), "negative_documents"))


SUITE = [T.Check("not_null", "o_orderkey"), T.Check("not_null", "o_custkey"), T.Check("accepted_values", "o_orderstatus", ("O", "F"), "warn"), T.Check("accepted_values", "o_orderpriority", ("1-URGENT", "2-HIGH"))]
SUITE_SQL = """SELECT 'not_null' AS test, 'orders' AS model, 'o_orderkey' AS "column", CAST(count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS failures, 'fail' AS worst FROM orders
UNION ALL SELECT 'not_null', 'orders', 'o_custkey', count(*) FILTER (o_custkey IS NULL), 'fail' FROM orders
UNION ALL SELECT 'accepted_values', 'orders', 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')), 'warn' FROM orders
UNION ALL SELECT 'accepted_values', 'orders', 'o_orderpriority', count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')), 'fail' FROM orders
UNION ALL SELECT 'unique', 'orders', 'o_orderkey', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)), 'fail'"""


@query(f"""SELECT test, model, "column", CASE WHEN failures = 0 THEN 'pass' ELSE worst END AS status, failures FROM ({SUITE_SQL})""")
def t6_suite(spark: SparkSession, d: str) -> DataFrame:
    return T.run_suite(table(spark, d, "orders"), "orders", SUITE, [["o_orderkey"]])


KEYS = [["o_orderkey"], ["o_custkey", "o_orderdate"], ["o_custkey", "o_orderstatus"], ["o_totalprice"], ["o_orderkey", "o_totalprice"]]


@query(" UNION ALL ".join(f"""SELECT 'unique' AS test, 'orders' AS model, '{",".join(k)}' AS "column", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) AS BIGINT) AS failures
FROM (SELECT 1 FROM orders WHERE {" AND ".join(f"{c} IS NOT NULL" for c in k)} GROUP BY {", ".join(k)} HAVING count(*) > 1)""" for k in KEYS))  # fmt: skip
def t11_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """Five keys of one table in one shuffle."""
    return T.unique_keys(table(spark, d, "orders"), "orders", KEYS)


@query("""SELECT 'orphan_line' AS failure_type, l_orderkey || '/' || l_linenumber AS keys, CAST(l_partkey AS VARCHAR) AS detail, 'line without an order that is not partial' AS description FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
UNION ALL SELECT 'duplicate_line', l_orderkey || '/' || l_linenumber, CAST(count(*) AS VARCHAR), 'line number used twice' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'early_shipping', l_orderkey || '/' || l_linenumber, CAST(date_diff('day', o_orderdate, l_shipdate) AS VARCHAR), 'shipped before ordered' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'no_lines', CAST(o_orderkey AS VARCHAR), o_orderstatus, 'order without lines' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'free_order', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), 'price is not positive' FROM orders WHERE o_totalprice <= 0""")
def t7_assertions(spark: SparkSession, d: str) -> DataFrame:
    return order_assertions(table(spark, d, "orders"), table(spark, d, "lineitem"))


def order_assertions(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Rules on lines and their orders in one join. Lines and orders are moved and sorted once, and no group is held in memory."""
    line, one_order = ["l_orderkey", "l_linenumber"], Window.partitionBy("o_orderkey")
    # Dealt by order, so that counting lines of a number and the join need no other shuffle.
    dealt = lines.select(*line, "l_partkey", "l_shipdate").repartition("l_orderkey").withColumn("nth_line", F.row_number().over(Window.partitionBy(*line).orderBy(*line)))
    dealt = dealt.withColumn("lines", F.count("*").over(Window.partitionBy(*line))).withColumn("is_line", F.lit(True))
    known = orders.select("o_orderkey", "o_orderstatus", "o_orderdate").repartition("o_orderkey").withColumn("nth_order", F.row_number().over(one_order.orderBy("o_orderkey")))
    known = known.withColumn("whole", F.coalesce(F.max(F.col("o_orderstatus") != "P").over(one_order), F.lit(False))).withColumn("is_order", F.lit(True))
    both = dealt.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "full_outer")
    # A line is there once for each of its orders.
    once = F.col("is_line") & (F.col("is_order").isNull() | (F.col("nth_order") == 1))
    found = T.row_assertions(both, [
        ("orphan_line", once & ~F.coalesce("whole", F.lit(False)), line, F.col("l_partkey"), "line without an order that is not partial"),
        ("duplicate_line", once & (F.col("lines") > 1) & (F.col("nth_line") == 1), line, F.col("lines"), "line number used twice"),
        ("early_shipping", F.col("l_shipdate") < F.col("o_orderdate"), line, F.datediff("l_shipdate", "o_orderdate"), "shipped before ordered"),
        ("no_lines", F.col("is_line").isNull(), ["o_orderkey"], F.col("o_orderstatus"), "order without lines"),
    ])
    return T.all_assertions([found, T.assertion("free_order", orders.filter("o_totalprice <= 0"), ["o_orderkey"], F.col("o_custkey"), "price is not positive")])


@query("SELECT o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1")
def t8_store_failures(spark: SparkSession, d: str) -> DataFrame:
    return IO.materialize(T.rejected_values(table(spark, d, "orders"), "o_orderstatus", ["O", "F"]), "failed_orders_status", "table", Scratch(spark, "failures").path("failed_orders_status"))


def customer_mart(customer: DataFrame, orders: DataFrame) -> P.Pipeline:
    """The customer mart as named steps."""
    mart = P.Pipeline({"customer": customer, "orders": orders})
    mart.step("stg_customers", lambda t: t["customer"].select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name")))
    mart.step("stg_orders", lambda t: t["orders"].select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_orderstatus").alias("status")))
    mart.step("customer_orders", lambda t: t["stg_customers"].join(t["stg_orders"], "customer_id", "left"))
    mart.step("customer_agg", lambda t: t["customer_orders"].groupBy("customer_id").agg(F.min("order_date").alias("first_order_date"), F.max("order_date").alias("most_recent_order_date"), F.count("order_id").alias("number_of_orders")))
    return mart.step("final", lambda t: t["stg_customers"].join(t["customer_agg"], "customer_id", "left"))


@query("""WITH f AS (SELECT c_custkey AS customer_id, CAST(count(o_orderkey) AS BIGINT) AS number_of_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1),
a AS (SELECT c_custkey AS customer_id, CAST(count(o_orderkey) AS BIGINT) AS number_of_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM f) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM a)""")
def t9_test_step(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    mart = customer_mart(customer, orders)
    expect = mart.build()["customer_agg"].select("customer_id", "number_of_orders")
    finished = customer_mart(customer, orders.filter("o_orderstatus = 'F'")).build()
    return P.test_step(mart, "customer_agg", {"customer_orders": finished["customer_orders"]}, expect)


@query(f"""SELECT status, CAST(count(*) AS BIGINT) AS tests, CAST(sum(failures) AS BIGINT) AS failures FROM (SELECT CASE WHEN failures = 0 THEN 'pass' ELSE worst END AS status, failures FROM ({SUITE_SQL})) GROUP BY 1""")
def t10_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return T.roll_up(t6_suite(spark, d))


# 2.9 Step profiles


def mart(spark: SparkSession, d: str) -> P.Pipeline:
    return customer_mart(table(spark, d, "customer"), table(spark, d, "orders"))


def mart_steps(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return mart(spark, d).build()


MART_SQL = """SELECT 1 AS step_order, 'stg_customers' AS step, CAST(count(*) AS BIGINT) AS rows FROM customer UNION ALL SELECT 2, 'stg_orders', count(*) FROM orders
UNION ALL SELECT 3, 'customer_orders', count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 4, 'customer_agg', count(*) FROM customer UNION ALL SELECT 5, 'final', count(*) FROM customer"""


@query(MART_SQL)
def p1_profile_steps(spark: SparkSession, d: str) -> DataFrame:
    return P.profile_pipeline(mart(spark, d), Scratch(spark, "profile"))


@query()
def p2_time_steps(spark: SparkSession, d: str) -> DataFrame:
    return P.time_steps(spark, mart_steps(spark, d))


@query(f"SELECT *, CASE WHEN rows / max(rows) OVER () >= 0.5 THEN 'hot' WHEN rows / max(rows) OVER () >= 0.2 THEN 'warm' ELSE 'cool' END AS tier FROM ({MART_SQL})")
def p3_heat_tier(spark: SparkSession, d: str) -> DataFrame:
    return P.heat_tier(p1_profile_steps(spark, d), "rows")


def clauses(spark: SparkSession, d: str) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The clauses of one query, each applied to what the one before gives; the first to ``orders``."""
    customer, lineitem = table(spark, d, "customer"), table(spark, d, "lineitem")
    return [
        ("from", lambda df: df), ("join customer", lambda df: df.join(customer, F.col("o_custkey") == F.col("c_custkey"))), ("join lineitem", lambda df: df.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"))),
        ("where", lambda df: df.filter("o_orderstatus = 'F'")), ("group", lambda df: df.groupBy("c_mktsegment", "l_returnflag").agg(F.count("*").alias("n"))), ("having", lambda df: df.filter("n > 1000")), ("select", lambda df: df.select("c_mktsegment", "n")),
    ]


CLAUSES_SQL = """WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT * FROM j JOIN lineitem ON o_orderkey = l_orderkey), w AS (SELECT * FROM k WHERE o_orderstatus = 'F'),
g AS (SELECT c_mktsegment, l_returnflag, count(*) AS n FROM w GROUP BY 1, 2), p AS (SELECT 1 AS step_order, 'from' AS step, CAST(count(*) AS BIGINT) AS rows FROM orders UNION ALL SELECT 2, 'join customer', count(*) FROM j
UNION ALL SELECT 3, 'join lineitem', count(*) FROM k UNION ALL SELECT 4, 'where', count(*) FROM w UNION ALL SELECT 5, 'group', count(*) FROM g UNION ALL SELECT 6, 'having', count(*) FROM g WHERE n > 1000 UNION ALL SELECT 7, 'select', count(*) FROM g WHERE n > 1000)"""


@query(f"{CLAUSES_SQL} SELECT * FROM p")
def p4_clause_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.profile_chain(clauses(spark, d), table(spark, d, "orders"))


@query(f"SELECT *, lag(rows) OVER (ORDER BY step_order) AS prev_rows, coalesce(rows > lag(rows) OVER (ORDER BY step_order), false) AS fan_out FROM ({MART_SQL})")
def p5_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return P.fan_out(p1_profile_steps(spark, d))


@query("SELECT 1 AS step_order, 'orders' AS step, CAST(count(*) AS BIGINT) AS rows, count(*) = 0 AS is_empty FROM orders UNION ALL SELECT 2, 'cheap', count(*), count(*) = 0 FROM orders WHERE o_totalprice < 0")
def p6_empty_steps(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return P.empty_steps(P.profile_steps({"orders": orders, "cheap": orders.filter("o_totalprice < 0")}))


@query("SELECT 'customer' AS leg, CAST(count(*) AS BIGINT) AS rows FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def p7_leg_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.leg_counts({n: table(spark, d, n) for n in ("customer", "supplier")})


@query("""SELECT key, left_rows, right_rows, left_rows * right_rows AS joined_rows FROM (SELECT o_orderkey AS key, CAST(count(*) AS BIGINT) AS left_rows FROM orders GROUP BY 1)
JOIN (SELECT l_orderkey AS key, CAST(count(*) AS BIGINT) AS right_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1) USING (key)""")
def p8_key_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return P.key_multiplicity(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT customer_id, order_id, CAST(total_rows AS BIGINT) AS total_rows FROM (SELECT c_custkey AS customer_id, o_orderkey AS order_id, count(*) OVER () AS total_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey) ORDER BY customer_id, order_id LIMIT 50")
def p9_step_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.with_total(mart_steps(spark, d)["customer_orders"].select("customer_id", "order_id"), 50, "customer_id", "order_id")


# 2.10 Column profiles

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (v IS NULL OR v = '') AS BIGINT) AS nulls, round(count(*) FILTER (v IS NULL OR v = '') * 100.0 / count(*), 2) AS null_percent
FROM (SELECT CAST({"CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END" if c == "o_orderstatus" else c} AS VARCHAR) AS v FROM orders)""" for c in ORDERS))  # fmt: skip
def c1_null_profile(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "O", None).otherwise(F.col("o_orderstatus"))
    return C.null_profile(table(spark, d, "orders").select(*ORDERS).withColumn("o_orderstatus", status))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", min({c}) AS min, max({c}) AS max, round(avg({c}), 2) AS mean FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def c2_numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.numeric_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""SELECT CAST(least(9, floor((l_extendedprice - lo) / (hi - lo) * 10)) AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1""")
def c3_histogram(spark: SparkSession, d: str) -> DataFrame:
    return C.histogram(table(spark, d, "lineitem"), "l_extendedprice")


@query("SELECT CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS trues, CAST(count(*) FILTER (toxic <> 1) AS BIGINT) AS falses, round(count(*) FILTER (toxic = 1) * 100.0 / count(*), 2) AS true_percent FROM labels")
def c4_boolean_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.boolean_profile(table(spark, d, "labels").withColumn("toxic", F.col("toxic").cast("string")), "toxic")


@query("SELECT CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last FROM orders")
def c5_date_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.date_profile(table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")), "day")


@query("""WITH p AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), n AS (SELECT "column", value, CAST(count(*) AS BIGINT) AS n FROM p WHERE value <> '' GROUP BY 1, 2),
r AS (SELECT *, CAST(count(*) OVER (PARTITION BY "column") AS BIGINT) AS distinct_values, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM n) SELECT "column", distinct_values, value, n FROM r WHERE place <= 5""")
def c6_text_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.text_profile(table(spark, d, "documents"), ["lang", "source"])


@query("""SELECT * FROM (VALUES ('o_orderkey', 'number'), ('o_orderstatus', 'string'), ('o_totalprice', 'number'), ('o_orderdate', 'date'), ('flag', 'boolean')) v("column", kind)""")
def c7_inferred_types(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    texts = orders.select("o_orderkey", *[F.col(c).cast("string").alias(c) for c in ("o_orderstatus", "o_totalprice", "o_orderdate")], (F.col("o_totalprice") > 1000).cast("string").alias("flag"))
    return C.inferred_types(texts, "o_orderkey")


# 2.10 Column profiles from stored states


def orders_with_period(spark: SparkSession, d: str) -> DataFrame:
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_totalprice", status.alias("o_orderstatus"), "o_orderpriority", "o_custkey", month.alias("month"))


def corrected(orders: DataFrame, month: int) -> DataFrame:
    """What one month turns out to be later on: twice the prices, and a status of its own."""
    return orders.filter(F.col("month") == month).withColumns({"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("C")})


CORRECTED_SQL = """o AS (SELECT CASE WHEN m = 199503 THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN m = 199503 THEN 'C' WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, o_custkey
  FROM (SELECT *, year(o_orderdate) * 100 + month(o_orderdate) AS m FROM orders))"""


@query(f"""WITH {CORRECTED_SQL}, p AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM o UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM o),
s AS (SELECT "column", CAST(count(value) AS BIGINT) AS n, CAST(count(*) - count(value) AS BIGINT) AS nulls, CAST(count(DISTINCT value) AS BIGINT) AS distinct_values FROM p GROUP BY 1),
v AS (SELECT "column", value, CAST(count(*) AS BIGINT) AS value_n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS place FROM p WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT "column", n, nulls, distinct_values, value, value_n FROM s JOIN v USING ("column") WHERE place <= 5""")
def c8_text_profile_from_states(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all months from stored states, after one month was corrected and its state replaced."""
    path, orders = Scratch(spark, "states").path("texts"), orders_with_period(spark, d)
    texts = ["o_orderstatus", "o_orderpriority"]
    K.store_states(K.text_states(orders, ["month"], texts), path, "month")
    K.store_states(K.text_states(corrected(orders, 199503), ["month"], texts), path, "month")
    return K.text_profile_from_states(spark.read.parquet(path))


@query(f"""WITH {CORRECTED_SQL}, x AS (SELECT price, c_mktsegment FROM o JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, CAST(count(price) AS BIGINT) AS n, min(price) AS least, max(price) AS greatest, round(avg(price), 2) AS mean, true AS low_in_bounds, true AS high_in_bounds FROM x GROUP BY 1""")
def c9_intervals_from_states(spark: SparkSession, d: str) -> DataFrame:
    """Mean and 5th and 95th percentiles of prices by segment from states by month and segment, one month replaced.

    The percentiles are estimates: what is returned is whether their true ranks lie within the bound that is stated for them, doubled.
    """
    path, segments = Scratch(spark, "states").path("prices"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = orders_with_period(spark, d).join(segments, "o_custkey")
    by = ["month", "c_mktsegment"]
    K.store_states(K.number_states(orders, by, ["o_totalprice"]), path, "month")
    K.store_states(K.number_states(corrected(orders, 199503), by, ["o_totalprice"]), path, "month")
    # A row a segment: written, so that estimates are the same wherever they are read.
    found = Scratch(spark, "states").table(K.number_profile(spark.read.parquet(path), ["c_mktsegment"], (0.05, 0.95)), "profile")
    now = orders.filter("month <> 199503").unionByName(corrected(orders, 199503))
    share = lambda i: F.avg((F.col("o_totalprice") <= F.col("quantiles")[i]).cast("double"))
    ranks = now.join(F.broadcast(found.select("c_mktsegment", "quantiles")), "c_mktsegment").groupBy("c_mktsegment").agg(F.count("*").alias("rows"), share(0).alias("low"), share(1).alias("high"))
    near = lambda c, q: F.abs(F.col(c) - q) <= 2 * K.rank_error() + 1 / F.col("rows")
    return found.join(ranks, "c_mktsegment").select("c_mktsegment", "n", "least", "greatest", F.round("mean", 2).alias("mean"), near("low", 0.05).alias("low_in_bounds"), near("high", 0.95).alias("high_in_bounds"))
