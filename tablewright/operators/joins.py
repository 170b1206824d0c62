"""Joins that need a rewrite to stay hash or merge joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_aggregates(dimension: DataFrame, aggregates: Sequence[DataFrame], key: str, zero: Sequence[str] = ()) -> DataFrame:
    """A star of left joins of aggregates onto one dimension; columns in ``zero`` become 0 where nothing matched."""
    out = dimension
    for a in aggregates:
        out = out.join(a, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def long_sides(df: DataFrame, sides: Sequence[str], key: str) -> DataFrame:
    """One row per side column, so that ``a = k OR b = k`` becomes one equality; a row whose sides agree counts once."""
    return df.withColumn(key, F.explode(F.array_distinct(F.array(*[F.col(s) for s in sides]))))


def join_either(dimension: DataFrame, facts: DataFrame, key: str, sides: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where any of ``sides`` equals ``key``, by way of the long form."""
    return dimension.join(long_sides(facts, sides, key), key, how)


def ordered_pairs(df: DataFrame, key: str, group: str) -> DataFrame:
    """Pairs (a, b) of different keys within a small group, by an equality on the group."""
    a = df.select(F.col(group), F.col(key).alias("a"))
    b = df.select(F.col(group), F.col(key).alias("b"))
    return a.join(b, group).filter("a <> b")


def up_to_cutoff(df: DataFrame, key: str, order: str, is_hit: Column, n: int) -> DataFrame:
    """Rows of each key up to its n-th hit by ``order``; all rows of keys with fewer. One window, no self join."""
    w = Window.partitionBy(key).orderBy(order)
    hits = F.sum(F.when(is_hit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_hits", hits).filter((F.col("_hits") < n) | ((F.col("_hits") == n) & is_hit)).drop("_hits")


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ids of a pair in one order."""
    return F.least(a, b), F.greatest(a, b)


def join_to_latest(left: DataFrame, right: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """``left`` with ``values`` of the right row that holds each key's maximum of ``order``."""
    latest = right.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(order, *values)).alias("_latest"))
    return left.join(latest, key, "left").select(*left.columns, *[F.col(f"_latest.{v}").alias(v) for v in values])
