"""Joins with few keys against plain joins, by broadcast and by filter, and what a search moves."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import graph as G
from tablewright.operators import near as N
from tablewright.plans.scratch import Scratch


@pytest.mark.parametrize("few,bits", [(1 << 18, 1 << 27), (-1, 1 << 27), (-1, 1 << 15), (-1, 8)])
def test_near_joins_are_exact(spark, monkeypatch, few, bits):
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "FILTER_BITS", bits)
    scratch, name = Scratch(spark, "test"), lambda c: F.when(F.col(c) % 101 > 0, F.format_string("k%d", c))
    df = spark.range(6000).select(name("id").alias("a"), (F.col("id") % 7).alias("b"), "id")
    keys = spark.range(0, 9000, 3).select(name("id").alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") + 1).alias("n"))
    keys = scratch.table(keys.union(spark.createDataFrame([("k1", 5, 0)], keys.schema)), "keys")
    for by in (["a"], ["a", "b"]):
        assert rows(N.meet(df, by, keys, scratch)) == rows(df.join(keys, by))
        assert rows(N.meet(df, by, keys, scratch, "left_semi").select("id")) == rows(df.join(keys, by, "left_semi").select("id"))
        assert rows(N.apart(df, by, keys, scratch)) == rows(df.join(keys, by, "left_anti").select(*df.columns))


def test_a_filter_lets_few_others_through(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", -1)
    scratch = Scratch(spark, "test")
    keys = scratch.table(spark.range(20000).select(F.format_string("k%d", "id").alias("a")), "keys")
    df = spark.range(100000).select(F.format_string("k%d", "id").alias("a"), "id")
    held = N._tested(df, ["a"], keys, 20000, scratch, "inner").filter("_held")
    assert held.filter("id < 20000").count() == 20000 and held.count() < 23000


def test_a_search_does_not_move_its_edges(spark):
    edges = spark.range(40000).select(F.concat(F.lit("a"), F.col("id") % 200).alias("parent"), F.concat(F.lit("b"), "id").alias("child"))
    starts = spark.createDataFrame([("a7",)], "id string")
    tables = []
    keep, Scratch.table = Scratch.table, lambda self, df, name: tables.append((name, df)) or keep(self, df, name)
    try:
        assert G.reach(edges, starts).count() == 200
    finally:
        Scratch.table = keep
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString() for name, df in tables}
    assert "Exchange" not in plans["edges"] and "BroadcastHashJoin" in plans["round1"] and "SortMergeJoin [from_id" not in plans["round1"]
    assert not spark.catalog.listTables() or not [t for t in spark.catalog.listTables() if t.name.startswith("links_")]


def test_impact_of_repeated_nodes(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "z"), ("y", "z")], "parent string, child string")
    nodes = spark.createDataFrame([("y", "t"), ("y", "t"), ("z", "t"), ("x", "t")], "id string, type string")
    assert rows(G.impact(edges, nodes, "x")) == [("t", 2, 2, "low")]
