"""Kept reach, impact levels, cycles and stored versions against plain computations."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import graph as G
from tablewright.operators import reachability as A
from tablewright.operators import versions as V
from tablewright.plans.scratch import Scratch


def frame(spark, links):
    return spark.createDataFrame(sorted(links), "parent int, child int")


def distances(links, starts):
    found, front = dict.fromkeys(starts, 0), list(starts)
    while front:
        front = [c for p in front for a, c in sorted(links) if a == p and c not in found and not found.update({c: found[p] + 1})]
    return found


def closure(links):
    out = {}
    for n in {x for e in links for x in e}:
        seen, front = set(), [n]
        while front:
            front = [c for p in front for a, c in links if a == p and c not in seen and not seen.add(c)]
        out[n] = seen
    return out


@pytest.mark.parametrize("seed", range(2))
def test_reach_is_kept_up_to_date(spark, seed):
    r, scratch = random.Random(seed), Scratch(spark, "test")
    link = lambda: (r.randrange(24), r.randrange(24))
    links = {link() for _ in range(34)} | {(0, 1), (1, 2), (2, 3), (3, 1)}
    reached = spark.createDataFrame(sorted(distances(links, [0, 9]).items()), "id int, distance int")
    for _ in range(3):
        removed = set(r.sample(sorted(links), 7)) | {(0, 1)}
        added = {link() for _ in range(5)} | {r.choice(sorted(removed))}
        links = (links - removed) | added
        after = A.changed_edges(frame(spark, links | removed - added), frame(spark, added), frame(spark, removed))
        assert set(rows(after)) == links
        reached = A.updated_reach(reached, after, frame(spark, added), frame(spark, removed), scratch)
        assert dict(rows(reached)) == distances(links, [0, 9])


def test_a_cycle_does_not_hold_itself(spark):
    links = {(0, 1), (1, 2), (2, 3), (3, 1)}
    reached = spark.createDataFrame(sorted(distances(links, [0]).items()), "id int, distance int")
    after = frame(spark, links - {(0, 1)})
    assert rows(A.updated_reach(reached, after, after.limit(0), frame(spark, {(0, 1)}), Scratch(spark, "test"))) == [(0, 0)]


def test_impact_levels(spark):
    r = random.Random(4)
    links = {(r.randrange(40), r.randrange(40, 60)) for _ in range(60)} | {(i, i + 1) for i in range(60, 90)} | {(90, 91), (91, 92), (92, 90), (93, 93)} | {(94, i) for i in range(100, 130)}
    want = {n: len(c - {n}) for n, c in closure(links).items()}
    got = {x.id: (x.reached, x.level) for x in A.impact_levels(frame(spark, links), Scratch(spark, "test")).collect()}
    assert got == {n: (min(16, c), "low" if c <= 3 else "medium" if c <= 10 else "high") for n, c in want.items()} and len({v[1] for v in got.values()}) == 3
    some = [n for n in want if want[n]][:2]
    for n in some:
        single = G.impact(frame(spark, links), frame(spark, links).select(F.col("child").alias("id")).distinct().withColumn("type", F.lit("t")), n).first()
        assert single.level == got[n][1]


def test_cycles_with_nested_loops(spark):
    r = random.Random(8)
    links = {(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6), (6, 7), (7, 6), (8, 8), (9, 10), (10, 11)} | {(r.randrange(20, 45), r.randrange(20, 45)) for _ in range(34)}
    reach_ = closure(links)
    want = {(n, min(m for m in c if n in reach_[m]), sum(n in reach_[m] for m in c)) for n, c in reach_.items() if n in c}
    got = rows(A.cycles(frame(spark, links), Scratch(spark, "test")))
    assert set(got) == want and len(got) == len(want) and {(2, 0, 5), (6, 6, 2), (8, 8, 1)} <= want
    assert A.cycles(frame(spark, {(1, 2), (2, 3)}), Scratch(spark, "test")).collect() == []


def test_only_changed_ranges_are_read(spark, tmp_path):
    old, new, same = (f"file://{tmp_path}/{x}" for x in ("old", "new", "same"))
    df = spark.range(4000).select(F.format_string("k%05d", "id").alias("k"), (F.col("id") % 13).alias("v"), F.when(F.col("id") % 3 > 0, "x").alias("s"))
    V.store_version(df, old, "k", ranges=40)
    bounds = [r.bound for r in spark.read.parquet(f"{old}/bounds").orderBy("bound").collect()]
    assert len(bounds) == 39
    # One in a hundred rows of one range.
    low, high = bounds[20], bounds[21]
    edited = df.withColumn("v", F.when((F.col("k") >= low) & (F.col("k") < high) & (F.crc32("k") % 100 == 0), -1).otherwise(F.col("v")))
    edited = edited.filter(F.col("k") != low).orderBy(F.rand(1))
    V.store_version(edited, new, "k", like=old)
    assert V.differing_ranges(spark, old, new) == [21]
    diff = V.stored_diff(spark, old, new, "k")
    assert rows(diff) == rows(G.version_diff(df, edited, "k")) and diff.count() > 1
    plan = V.stored_diff(spark, old, new, "k")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*_range#\d+ = 21\)?\]", plan)) == 2, plan
    V.store_version(df.repartition(7), same, "k", like=old)
    assert V.differing_ranges(spark, old, same) == [] and V.stored_diff(spark, old, same, "k").collect() == []
    # Keys beyond the old ones lie in the first and last range.
    more = df.unionByName(spark.createDataFrame([("a", 1, "x"), ("z", 1, None)], df.schema))
    V.store_version(more, same, "k", like=old)
    assert V.differing_ranges(spark, old, same) == [0, 39] and rows(V.stored_diff(spark, old, same, "k")) == [("a", "added"), ("z", "added")]
