"""Incremental models on partitioned tables: only partitions that hold a changed key are read whole and written again.

A Bloom filter over the changed keys, a few bitmaps of fixed size in all, is tested against the key columns of the table, which
tells the partitions that may hold one of them. A full filter lets more partitions through; it never changes the
result. Partitions are replaced by dynamic overwrite, all others keep their files.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.plans.scratch import Scratch, delete_path
from tablewright.sources.io import upsert

#: Bits of a filter (16 MB at most) and the places that a key takes in it.
FILTER_BITS, PLACES = 1 << 27, 2
#: Fixed value: the partition of rows that are still valid.
OPEN = "open"


def _places(keys: Sequence[str], bits: int) -> Column:
    """The bitmap and the bit in it of each place of a key."""
    spots = [F.pmod(F.xxhash64(F.lit(i), *[F.col(k).cast("string") for k in keys]), F.lit(bits)) for i in range(PLACES)]
    return F.array(*[F.struct(F.bitmap_bucket_number(s + 1).alias("bucket"), F.bitmap_bit_position(s + 1).alias("bit")) for s in spots])


def key_filter(changes: DataFrame, keys: Sequence[str], bits: int = FILTER_BITS) -> DataFrame:
    """(bucket, bits): a Bloom filter over the keys of ``changes`` as bitmaps of 4 KB."""
    spots = changes.select(F.explode(_places(keys, bits)).alias("p")).select("p.*")
    return spots.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(df: DataFrame, keys: Sequence[str], bloom: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose key the filter may hold: all that it holds, and a few more."""
    out = df
    for i in range(PLACES):
        spot = _places(keys, bits)[i]
        hit = bloom.select(F.col("bucket").alias(f"bucket{i}"), F.col("bits").alias(f"bits{i}"))
        # The filter has ``bits`` / 32,768 rows at most.
        out = out.join(F.broadcast(hit), spot["bucket"] == F.col(f"bucket{i}"))
        byte = F.conv(F.hex(F.substring(F.col(f"bits{i}"), (spot["bit"] / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        out = out.filter(F.getbit(byte, (spot["bit"] % 8).cast("int")) == 1)
    return out.select(*df.columns)


def partitions_of(df: DataFrame, by: Sequence[str]) -> list[tuple]:
    """The partitions that ``df`` has rows in: as many as folders at most."""
    return [tuple(r) for r in df.select(*by).distinct().collect()]


def within(by: Sequence[str], partitions: Sequence[tuple]) -> Column:
    """Rows of these partitions, in a form that prunes folders."""
    same = lambda p: functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.lit(v)) if v is None else F.col(c) == F.lit(v) for c, v in zip(by, p)])
    if len(by) == 1 and all(p[0] is not None for p in partitions):
        return F.col(by[0]).isin([p[0] for p in partitions])
    return functools.reduce(operator.or_, [same(p) for p in partitions], F.lit(False))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes ``df`` in folders by the ``by`` columns, replacing what is there."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def _replace(spark, path: str, by: Sequence[str], fresh: DataFrame, touched: Sequence[tuple]) -> None:
    """Puts ``fresh``, a written table, in place of the ``touched`` partitions; those that it leaves empty go."""
    filled = set(partitions_of(fresh, by))
    fresh.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for gone in set(touched) - filled:
        delete_path(spark, "/".join([path, *[f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(by, gone)]]))


def upsert_partitioned(path: str, changes: DataFrame, keys: str | Sequence[str], by: Sequence[str], full_refresh: bool = False, bits: int = FILTER_BITS) -> list[tuple]:
    """Puts ``changes`` into the table at ``path`` in place of the rows with their keys; returns the partitions written.

    A key may move to another partition. Keys of null match nothing, as in ``upsert``. A full refresh replaces the table.
    The new partitions are written aside first; a run that failed in between is mended by running it again. Partition values
    are written as folder names, so they have none of the characters that these escape.
    """
    spark, keys = changes.sparkSession, [keys] if isinstance(keys, str) else list(keys)
    if full_refresh:
        write_partitioned(changes, path, by)
        return sorted(partitions_of(spark.read.parquet(path), by), key=repr)
    scratch = Scratch(spark, "upsert")
    target = spark.read.parquet(path)
    changes = scratch.table(changes.select(*[F.col(f.name).cast(f.dataType) for f in target.schema]), "changes")
    bloom = scratch.table(key_filter(changes.dropna(subset=keys), keys, bits), "filter")
    held = partitions_of(may_hold(target.select(*keys, *[c for c in by if c not in keys]), keys, bloom, bits), by)
    touched = sorted(set(held) | set(partitions_of(changes, by)), key=repr)
    fresh = scratch.table(upsert(target.filter(within(by, touched)), changes, keys), "fresh")
    _replace(spark, path, by, fresh, touched)
    scratch.drop(changes, bloom, fresh)
    return touched


def snapshot_partitioned(path: str, current: DataFrame, key: str, check: Sequence[str], by: str, as_of: str) -> list[tuple]:
    """Brings the history at ``path`` (key, check columns, valid_from; in folders by valid_to and ``by``) up to ``current``.

    Open rows lie in the folder ``valid_to=open``. Those whose checked columns or ``by`` changed, or whose key is gone, close on
    ``as_of``, in folders of that date; changed and new keys open a row. Only open folders with a change are written again, and
    folders of earlier dates are not read. Nulls are equal to nulls. Returns the partitions written.
    """
    spark, columns, folders = current.sparkSession, [key, *check, by], ["valid_to", by]
    scratch = Scratch(spark, "snapshot")
    open_ = spark.read.parquet(path).filter(F.col("valid_to") == OPEN).select(*columns, "valid_from")
    o, c = open_.alias("o"), current.select(*columns).alias("c")
    both = o.join(c, F.col(f"o.{key}") == F.col(f"c.{key}"), "full_outer")
    same = functools.reduce(operator.and_, [F.col(f"o.{x}").eqNullSafe(F.col(f"c.{x}")) for x in [*check, by]])
    was, now = F.col(f"o.{key}").isNotNull(), F.col(f"c.{key}").isNotNull()
    side = lambda s, valid_from, valid_to: F.struct(*[F.col(f"{s}.{x}").alias(x) for x in columns], valid_from.alias("valid_from"), valid_to.alias("valid_to"))
    closing = F.when(was, F.array(side("o", F.col("o.valid_from"), F.lit(as_of))))
    opening = F.when(now, F.array(side("c", F.lit(as_of), F.lit(OPEN))))
    none = F.array().cast(f"array<struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in open_.schema)}, valid_to:string>>")
    changed = both.filter(~(was & now & same)).select(F.explode(F.concat(F.coalesce(closing, none), F.coalesce(opening, none))).alias("r")).select("r.*")
    changed = scratch.table(changed, "changed")
    touched = [(OPEN, v) for (v,) in partitions_of(changed, [by])]
    # What stays open in a touched folder is what did not close; what closed on this date before stays too.
    inside = spark.read.parquet(path).filter(within([by], [(v,) for _, v in touched])).select(*changed.columns)
    stay = inside.filter(F.col("valid_to") == OPEN).join(changed.filter(F.col("valid_to") == as_of).select(key), key, "left_anti")
    fresh = scratch.table(stay.select(*changed.columns).unionByName(inside.filter(F.col("valid_to") == as_of)).unionByName(changed), "fresh")
    _replace(spark, path, folders, fresh, touched)
    out = sorted(set(touched) | set(partitions_of(changed, folders)), key=repr)
    scratch.drop(changed, fresh)
    return out
