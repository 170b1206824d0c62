"""Versions of a table stored by key ranges with a tree of digests, so that a comparison reads only ranges that differ.

The ranges of a first version hold for those compared with it. A range's digest doesn't depend on the order of its rows; the
digest of a node of the tree is made of its children's. Two trees are compared from the root down, and rows are read only
in ranges whose digests differ.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.graph import checksum, version_diff

#: Ranges of a version, and children of a node of its tree.
RANGES, FANOUT = 256, 16


def _bounds(df: DataFrame, key: str, ranges: int) -> list:
    """The least keys of evenly filled ranges, but the first: one for each range at most."""
    dealt = df.select(F.col(key).alias("key")).repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    return sorted({r.key for r in dealt.collect() if r.key is not None})[1:]


def _range_of(key: Column, bounds: list) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)


def store_version(df: DataFrame, path: str, key: str, ranges: int = RANGES, like: str | None = None) -> None:
    """Writes ``df`` under ``path`` by ranges of ``key`` (rows), with the ranges' bounds and the tree of digests.

    ``like`` is the path of an earlier version, whose ranges are used. Keys are not null; repeated keys count as often as they
    are there.
    """
    spark = df.sparkSession
    bounds = [r.bound for r in spark.read.parquet(f"{like}/bounds").orderBy("bound").collect()] if like else _bounds(df, key, ranges)
    kind = df.schema[key].dataType.simpleString()
    spark.createDataFrame([(b,) for b in bounds], f"bound {kind}").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    ranged = df.withColumn("_range", _range_of(F.col(key), bounds).cast("int"))
    ranged.repartition("_range").write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    digests = checksum(stored.drop("_range"), key)
    part = _range_of(F.col(key), bounds).cast("int").alias("node")
    # Sums of two hashes and a count: the same whatever the order.
    sums = [F.sum(F.xxhash64(F.lit(i), F.col(key), "digest").cast("decimal(38,0)")).cast("string") for i in (0, 1)]
    level = digests.groupBy(part).agg(F.md5(F.concat_ws("/", *sums, F.count("*").cast("string"))).alias("digest")).withColumn("level", F.lit(0))
    tree = level
    for i in range(1, max(1, math.ceil(math.log(max(2, len(bounds) + 1), FANOUT))) + 1):
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.md5(children).alias("digest")).withColumn("level", F.lit(i))
        tree = tree.unionByName(level)
    tree.select("level", "node", "digest").coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def differing_ranges(spark: SparkSession, old: str, new: str) -> list[int]:
    """The ranges whose digests differ between two stored versions, found from the root down: numbers of ranges at most."""
    a, b = (spark.read.parquet(f"{p}/tree").withColumnRenamed("digest", side) for p, side in ((old, "a"), (new, "b")))
    apart = a.join(b, ["level", "node"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")
    top = max(r[0] or 0 for r in (t.agg(F.max("level")).first() for t in (a, b)))
    nodes: list[int] | None = None
    for level in range(top, -1, -1):
        here = apart.filter(F.col("level") == level)
        if nodes is not None:
            here = here.filter(F.floor(F.col("node") / FANOUT).isin(nodes))
        nodes = sorted(r.node for r in here.collect())
        if not nodes:
            return []
    return nodes or []


def stored_diff(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """(key, change) between two stored versions, as ``version_diff`` gives; rows of equal ranges are not read."""
    ranges = differing_ranges(spark, old, new)
    rows = [spark.read.parquet(f"{p}/rows").filter(F.col("_range").isin(ranges) if ranges else F.lit(False)).drop("_range") for p in (old, new)]
    return version_diff(*rows, key)
