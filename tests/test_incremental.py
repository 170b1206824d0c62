"""Incremental models on partitioned tables: what is written again, and what is not."""

from conftest import rows
from pyspark.sql import functions as F

from tablewright.sources import incremental as N
from tablewright.sources import io as IO


def files(path):
    """Data files by folder, with the time of their last change."""
    return {p.parent.relative_to(path).as_posix(): (p.name, p.stat().st_mtime_ns) for p in path.rglob("*.parquet")}


def test_filter_holds_its_keys(spark):
    keys = spark.range(0, 4000, 40).select(F.col("id").alias("k"), F.when(F.col("id") % 80 == 0, "a").otherwise("é").alias("s"))
    for bits, most in ((1 << 22, 5), (1 << 15, 60), (8, 4000)):
        bloom = N.key_filter(keys, ["k", "s"], bits)
        assert bloom.count() <= max(1, bits // 32_768)
        for s, wanted in (("a", 50), ("é", 50)):
            held = N.may_hold(spark.range(4000).select(F.col("id").alias("k"), F.lit(s).alias("s")), ["k", "s"], bloom, bits)
            assert held.join(keys, ["k", "s"], "left_semi").count() == wanted
            assert held.count() <= wanted + most


def test_upsert_leaves_other_partitions(spark, tmp_path):
    path = tmp_path / "t"
    target = spark.createDataFrame([(i, i // 10, f"v{i}", "x") for i in range(60)] + [(None, 0, "no key", "x")], "k long, p int, v string, extra string")
    N.write_partitioned(target, f"file://{path}", ["p"])
    before = files(path)
    changes = spark.createDataFrame([(11, 1, "new", None), (12, 3, "moved", None), (99, 7, "added", None), *[(i, 4, "merged", None) for i in range(20, 30)]], "k long, p int, v string, extra string")
    want = rows(IO.upsert(target, changes, "k"))
    touched = N.upsert_partitioned(f"file://{path}", changes, "k", ["p"])
    assert touched == [(1,), (2,), (3,), (4,), (7,)]
    assert rows(spark.read.parquet(f"file://{path}").select(*target.columns)) == want
    after = files(path)
    assert {d for d in before if before[d] == after.get(d)} == {"p=0", "p=5"}
    # All rows of partition 2 moved, so its folder is gone.
    assert set(after) == {"p=0", "p=1", "p=3", "p=4", "p=5", "p=7"}
    # The same changes again change nothing but the files.
    N.upsert_partitioned(f"file://{path}", changes, "k", ["p"])
    assert rows(spark.read.parquet(f"file://{path}").select(*target.columns)) == want


def test_upsert_of_two_keys_and_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    target = spark.createDataFrame([(i, c, i % 3, c, 0) for i in range(12) for c in "ab"], "k long, c string, p int, q string, v int")
    N.write_partitioned(target, path, ["p", "q"])
    changes = target.filter("k = 4 AND c = 'a'").withColumn("v", F.lit(9))
    assert N.upsert_partitioned(path, changes, ["k", "c"], ["p", "q"]) == [(1, "a")]
    assert rows(spark.read.parquet(path).filter("v = 9").select("k", "c")) == [(4, "a")] and spark.read.parquet(path).count() == 24
    assert N.upsert_partitioned(path, changes.limit(0), ["k", "c"], ["p", "q"]) == [] and spark.read.parquet(path).count() == 24
    assert N.upsert_partitioned(path, changes, ["k", "c"], ["p", "q"], full_refresh=True) == [(1, "a")] and spark.read.parquet(path).count() == 1


def test_history_leaves_closed_and_unchanged_partitions(spark, tmp_path):
    path = tmp_path / "h"
    first = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", 2), (4, "d", 3)], "k long, v string, p int")
    N.write_partitioned(first.withColumns({"valid_from": F.lit("d0"), "valid_to": F.lit(N.OPEN)}), f"file://{path}", ["valid_to", "p"])
    before = files(path)
    second = spark.createDataFrame([(1, "A", 1), (2, None, 1), (3, "c", 2), (5, "e", 1)], "k long, v string, p int")
    third = spark.createDataFrame([(1, "A", 2), (2, "b", 1), (3, "c", 2), (5, "e", 1)], "k long, v string, p int")
    for version, as_of, written in ((second, "d1", 4), (second, "d2", 0), (third, "d2", 3)):
        assert len(N.snapshot_partitioned(f"file://{path}", version, "k", ["v"], "p", as_of)) == written
        if as_of == "d1":
            after = files(path)
            assert before["valid_to=open/p=2"] == after["valid_to=open/p=2"] and "valid_to=open/p=3" not in after
    assert files(path)["valid_to=d1/p=1"] == after["valid_to=d1/p=1"]
    want = [(1, "a", 1, "d0", "d1"), (1, "A", 1, "d1", "d2"), (1, "A", 2, "d2", "open"), (2, None, 1, "d0", "d2"), (2, "b", 1, "d2", "open"), (3, "c", 2, "d0", "open"), (4, "d", 3, "d0", "d1"), (5, "e", 1, "d1", "open")]
    assert rows(spark.read.parquet(f"file://{path}").select("k", "v", "p", "valid_from", "valid_to")) == sorted(want, key=repr)
