"""What the rounds of kept reach and of impact levels move and read."""

from pyspark.sql import functions as F

from tablewright.operators import reachability as A
from tablewright.plans.scratch import Scratch


def recorded(run):
    """The tables that ``run`` writes, by name, with what it returns."""
    tables, keep = {}, Scratch.table

    def table(self, df, name):
        tables.setdefault(name, []).append(keep(self, df, name))
        return tables[name][-1]

    Scratch.table = table
    try:
        return tables, run()
    finally:
        Scratch.table = keep


def tree(spark, n):
    """A root, ten nodes below it and ``n`` leaves; half of the nodes hang from another root."""
    top = spark.range(10).select(F.when(F.col("id") < 5, "root").otherwise("other").alias("parent"), F.concat(F.lit("m"), "id").alias("child"))
    return top.unionByName(spark.range(n).select(F.concat(F.lit("m"), F.col("id") % 10).alias("parent"), F.concat(F.lit("x"), "id").alias("child")))


def test_a_batch_does_not_move_all_edges(spark):
    scratch = Scratch(spark, "test")
    edges = scratch.table(tree(spark, 2000), "edges")
    removed, added = edges.filter("child = 'x1'"), spark.createDataFrame([("root", "m9")], "parent string, child string")
    after = A.changed_edges(edges, added, removed)
    assert "Exchange hashpartitioning" not in after._jdf.queryExecution().executedPlan().toString()
    after = scratch.table(after, "edges")
    before = spark.createDataFrame([("root", 0), *[(f"m{i}", 1) for i in range(5)], *[(f"x{i}", 2) for i in range(2000) if i % 10 < 5]], "id string, distance int")
    tables, got = recorded(lambda: A.updated_reach(before, after, added, removed, scratch))
    assert {r.id for r in got.collect()} == {"root", *[f"m{i}" for i in (0, 1, 2, 3, 4, 9)], *[f"x{i}" for i in range(2000) if i % 10 in (0, 1, 2, 3, 4, 9) and i != 1]}
    assert tables["within"][0].count() == 5 + 999 + 1


def test_later_rounds_of_levels_read_no_edges_to_leaves(spark):
    tables, got = recorded(lambda: A.impact_levels(tree(spark, 2000), Scratch(spark, "test")))
    assert got.count() == 2012 and got.filter("reached = 16 AND level = 'high'").count() == 12 and got.filter("reached = 0 AND level = 'low'").count() == 2000
    assert tables["inner"][0].count() == 10 and tables["carriers"][0].count() == 2 and tables["sketches"][-1].count() == 2
