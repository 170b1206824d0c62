"""Profiles of branching pipelines: rows as counted step by step, from one scan of each source."""

import re

from conftest import rows
from pyspark.sql import functions as F

from tablewright.plans import steps as P
from tablewright.plans.scratch import Scratch


def branching(spark):
    a = spark.range(100).withColumn("g", F.col("id") % 7)
    b = spark.range(0, 100, 3).withColumn("w", F.col("id") * 2)
    return (
        P.Pipeline({"a": a, "b": b})
        .step("left", lambda t: t["a"].filter("id > 10"))
        .step("right", lambda t: t["b"].filter("w < 150"))
        .step("joined", lambda t: t["left"].join(t["right"], "id", "left"))
        .step("by_group", lambda t: t["joined"].groupBy("g").count())
        .step("odd", lambda t: t["joined"].filter("id % 2 = 1"))
        .step("both", lambda t: t["odd"].join(t["by_group"], "g"))
        .step("twice", lambda t: t["both"].alias("x").join(t["both"].alias("y"), "id").select("id"))
        .step("self", lambda t: (lambda d: d.alias("x").join(d.alias("y"), "id").select("id"))(t["right"]))
        .step("nothing", lambda t: t["self"].filter("id < 0"))
    )


def test_counts_equal_those_of_single_steps(spark):
    pipeline = branching(spark)
    got = rows(P.profile_pipeline(pipeline, Scratch(spark, "test")))
    assert got == rows(P.profile_steps(pipeline.build()))
    assert {r[1]: r[2] for r in got} | {"nothing": 0, "left": 89, "joined": 89} == {r[1]: r[2] for r in got}


def test_inputs_of_steps(spark):
    inputs = P.step_inputs(branching(spark))
    assert inputs["joined"] == ["left", "right"] and inputs["twice"] == ["both", "both"] and inputs["left"] == ["a"]


def test_empty_side_is_counted_all_the_same(spark):
    pipeline = P.Pipeline({"a": spark.range(50), "b": spark.range(5)}).step("some", lambda t: t["a"].filter("id < 40")).step("none", lambda t: t["b"].filter("id > 40")).step("met", lambda t: t["some"].join(t["none"], "id"))
    assert [r[2] for r in rows(P.profile_pipeline(pipeline, Scratch(spark, "test")))] == [40, 0, 0]


def test_one_scan_of_each_source(spark, tmp_path):
    paths = {n: f"file://{tmp_path}/{n}" for n in ("a", "b")}
    whole = branching(spark)
    for n, path in paths.items():
        whole.sources[n].write.parquet(path)
    pipeline = P.Pipeline({n: spark.read.parquet(p) for n, p in paths.items()})
    pipeline.steps = whole.steps
    scratch = Scratch(spark, "test")
    seen = []
    write = scratch.table
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scratch.table = lambda df, name: (seen.append(plan_of(df)), write(df, name))[1]
    frames, _ = P.observed_steps(pipeline, scratch)
    assert list(frames) == ["twice", "nothing"]
    plans = "\n".join([*seen, *map(plan_of, frames.values())])
    # Steps that several read are read from where they were written.
    assert [len(re.findall(rf"FileScan parquet .*{re.escape(str(tmp_path))}/{n}\b", plans)) for n in paths] == [1, 1], plans
