"""Joins of a large table with few keys, for searches that go in rounds: only rows that may match are moved.

Few keys are broadcast. More of them become a Bloom filter of bitmaps of fixed size in all, which rows are tested against
where they are; those that pass are joined exactly. A full filter lets more rows through; it never changes the result.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.plans.scratch import Scratch

#: Keys that are broadcast as they are; bits of a filter for a key, as long as it isn't full; its bits at most (32 MB).
FEW, BITS_OF_A_KEY, FILTER_BITS = 1 << 18, 16, 1 << 28
#: Bits of a bitmap, as Spark builds them. All places of a key lie in one bitmap.
BITMAP, PLACES = 1 << 15, 2


def _places(by: Sequence[str], bits: int) -> tuple[Column, list[Column]]:
    """The bitmap of a key and its places there, from separate bits of one hash."""
    spot = F.xxhash64(*by)
    return F.shiftrightunsigned(spot, 34).bitwiseAND(bits // BITMAP - 1), [F.shiftrightunsigned(spot, 17 * i).bitwiseAND(BITMAP - 1).cast("int") for i in range(PLACES)]


def _filter(keys: DataFrame, by: Sequence[str], bits: int) -> DataFrame:
    """(bitmap, words): the keys' bits as integers."""
    bitmap, places = _places(by, bits)
    set_ = keys.select(bitmap.alias("bitmap"), F.explode(F.array(*places)).alias("place")).groupBy("bitmap").agg(F.bitmap_construct_agg("place").alias("bits"))
    word = lambda i: F.conv(F.hex(F.substring("bits", i * 4 + 1, 4)), 16, 10).cast("long")
    signed = lambda w: F.when(w < 1 << 31, w).otherwise(w - (1 << 32)).cast("int")
    return set_.select("bitmap", F.transform(F.sequence(F.lit(0), F.lit(BITMAP // 32 - 1)), lambda i: signed(word(i))).alias("words"))


def _tested(df: DataFrame, by: Sequence[str], keys: DataFrame, n: int, scratch: Scratch, how: str) -> DataFrame:
    """``df`` with a column ``_held`` that is true where the filter may hold the row's key, and not where it surely doesn't."""
    bits = min(FILTER_BITS, max(BITMAP, 1 << (BITS_OF_A_KEY * n - 1).bit_length()))
    stored = scratch.table(_filter(keys, by, bits), "filter")
    bitmap, places = _places(by, bits)
    # Bytes of a word come in order, the bits of a byte from the least.
    bit = lambda p: F.getbit(F.get("words", F.shiftright(p, 5)), (3 - F.shiftright(p, 3).bitwiseAND(3)) * 8 + p.bitwiseAND(7))
    held = functools.reduce(operator.and_, [bit(p) == 1 for p in places])
    # The filter has FILTER_BITS / BITMAP rows at most.
    met = df.join(F.broadcast(stored), bitmap == F.col("bitmap"), how)
    return met.select(*df.columns, F.coalesce(held, F.lit(False)).alias("_held"))


def meet(df: DataFrame, by: Sequence[str], keys: DataFrame, scratch: Scratch, how: str = "inner") -> DataFrame:
    """``df`` joined with ``keys``, a written table, by the columns ``by`` of both; ``how`` is inner or left_semi."""
    n = keys.count()
    if n <= FEW:
        return df.join(F.broadcast(keys), list(by), how)
    # A filter with a bit or two for a key holds nearly all.
    held = df if n > FILTER_BITS // 2 else _tested(df, by, keys, n, scratch, "inner").filter("_held").drop("_held")
    return held.join(keys, list(by), how)


def apart(df: DataFrame, by: Sequence[str], keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``df`` whose columns ``by`` are not among those of ``keys``, a written table."""
    n, keys = keys.count(), keys.select(*by)
    if n <= FEW:
        return df.join(F.broadcast(keys), list(by), "left_anti")
    if n > FILTER_BITS // 2:
        return df.join(keys, list(by), "left_anti")
    tested = _tested(df, by, keys, n, scratch, "left")
    held = tested.filter("_held").drop("_held")
    return tested.filter("NOT _held").drop("_held").unionByName(held.join(keys, list(by), "left_anti").select(*df.columns))
