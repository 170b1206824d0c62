"""Assertions on orders and lines in one join: repeated and null keys, and what the plan moves and holds."""

from conftest import rows
from pyspark.sql import functions as F

from tablewright.queries import testing as Q


def test_repeated_and_null_keys_and_the_plan(spark):
    orders = spark.createDataFrame(
        [(1, 10, "O", "2020-01-05", 5.0), (1, 11, "P", "2020-01-09", 5.0), (2, 12, "P", "2020-01-01", 0.0), (2, 12, "P", "2020-01-01", 1.0), (3, 13, None, "2020-01-01", 1.0), (4, 14, "F", "2020-01-01", 1.0), (None, 15, "F", "2020-01-01", 1.0)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_totalprice double",
    ).withColumn("o_orderdate", F.to_timestamp("o_orderdate"))
    lines = spark.createDataFrame(
        [(1, 7, 1, "2020-01-04"), (1, 8, 1, "2020-01-06"), (2, 9, 1, "2020-01-02"), (3, 9, 2, None), (5, 9, 1, "2020-01-02"), (5, 9, 1, "2020-01-02"), (5, 9, 1, "2020-01-02"), (None, 6, 1, "2020-01-02"), (None, 6, 1, "2020-01-02")],
        "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate string",
    ).withColumn("l_shipdate", F.to_timestamp("l_shipdate"))
    found = Q.order_assertions(orders, lines)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = [r[:3] for r in rows(found)]
    assert got == sorted(
        [("orphan_line", k, p) for k, p in (("2/1", "9"), ("3/2", "9"), ("5/1", "9"), ("5/1", "9"), ("5/1", "9"), ("1", "6"), ("1", "6"))]
        + [("duplicate_line", "1/1", "2"), ("duplicate_line", "5/1", "3"), ("duplicate_line", "1", "2")]
        + [("early_shipping", "1/1", d) for d in ("-1", "-5", "-3")]
        + [("no_lines", "4", "F"), ("no_lines", "", "F"), ("free_order", "2", "12")], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    physical = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in physical and plan.count("RepartitionByExpression") == 2 and plan.count("Join") == 1
