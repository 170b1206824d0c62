"""Window operators; every window has a partition.

Ranks within few large groups are taken by ranges: rows are dealt in order over tasks, ranked within their task, and shifted
by the rows of the tasks before, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.plans.scratch import Scratch


def first_last_flags(df: DataFrame, key: str, *order: str) -> DataFrame:
    """is_first and is_last of each key's rows by ``order``, whose last column breaks ties."""
    up = Window.partitionBy(key).orderBy(*order)
    down = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("is_first", F.row_number().over(up) == 1).withColumn("is_last", F.row_number().over(down) == 1)


def with_previous(df: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def rank_gaps(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value is more than one above the one before in their key."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(value))
    return df.withColumn("previous", prev).filter(F.col(value) - F.col("previous") > 1)


def _before(dealt: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column) -> DataFrame:
    """``dealt``, rows in ranges (part) of ``keys`` and ``order``, with before: the weights of its key's rows before each."""
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    # A row a key and task.
    sums = dealt.groupBy("part", *keys).agg(F.sum(weight).alias("here"))
    past = F.sum("here").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("earlier", F.coalesce(past, F.lit(0)))
    inside = F.sum(weight).over(Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    own = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).alias("d")
    met = own.join(sums.alias("s"), [F.col("d.part") == F.col("s.part"), *same])
    return met.select("d.*", F.col("s.earlier")).withColumn("before", F.col("inside") + F.col("earlier")).drop("inside", "earlier", "part")


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column], scratch: Scratch) -> DataFrame:
    return scratch.table(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("part", F.spark_partition_id()), "ranges")


def counts_before(df: DataFrame, keys: Sequence[str], value: str, scratch: Scratch, descending: bool = False) -> DataFrame:
    """(keys, value, rows, before): each distinct value of a key, its rows, and the key's rows of values before it."""
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("rows"))
    return _before(_dealt(counted, keys, order, scratch), keys, order, F.col("rows"))


def ranked_values(df: DataFrame, key: str, value: str, scratch: Scratch, name: str = "place") -> DataFrame:
    """``df`` with its rank within ``key`` by ``value``, highest first; equal values share the rank of their first."""
    ranks = counts_before(df, [key], value, scratch, True).select(F.col(key).alias("_key"), F.col(value).alias("_value"), (F.col("before") + 1).cast("int").alias(name))
    on = F.col(key).eqNullSafe(F.col("_key")) & F.col(value).eqNullSafe(F.col("_value"))
    return df.join(scratch.table(ranks, "ranks"), on).drop("_key", "_value")


def reseed(df: DataFrame, group: str, order: Sequence[Column], label: Column, scratch: Scratch) -> DataFrame:
    """Survivors ranked anew in their group, with a label made of the group's and the new rank; ``order`` leaves no ties."""
    placed = _before(_dealt(df, [group], order, scratch), [group], order, F.lit(1))
    return placed.withColumn("seed", (F.col("before") + 1).cast("int")).drop("before").withColumn("label", F.concat(label, F.lit("-"), F.col("seed").cast("string")))


def deciding_criterion(df: DataFrame, tied_by: Sequence[str], criteria: Sequence[str]) -> DataFrame:
    """``df`` with decided_by: the first criterion with more than one value among rows tied on ``tied_by``, or none.

    A row that is tied with no other is decided by ``record``.
    """
    w = Window.partitionBy(*tied_by)
    out = F.lit("none")
    for c in reversed(criteria):
        # Least against greatest tells whether there are two values without gathering them.
        out = F.when(~F.min(c).over(w).eqNullSafe(F.max(c).over(w)), c).otherwise(out)
    return df.withColumn("decided_by", F.when(F.count("*").over(w) == 1, "record").otherwise(out))
