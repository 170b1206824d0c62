"""A table's own columns beside an operator's, whatever the table's are called.

An operator packs its input's columns into one struct, works under names of its own, and unpacks them at the end. An output
whose name the input already uses gets underscores after it, so the input's column keeps its name and values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids (with a number or two) that are broadcast at most, about 50 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text that may go with them.
BROADCAST_TEXT = 1 << 26


def own(df: DataFrame) -> list[Column]:
    """All columns of ``df``, quoted."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name`` with as many underscores after it as it takes to differ from all ``taken``, case aside."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def packed(df: DataFrame, *inner: Column) -> DataFrame:
    """``row``, a struct of all columns of ``df``, beside ``inner`` columns."""
    return df.select(F.struct(*own(df)).alias("row"), *inner)


def unpacked(df: DataFrame, columns: list[str], **outputs: Column) -> DataFrame:
    """The ``columns`` out of ``row`` and the ``outputs``, each under its free name."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns], *[c.alias(free_name(n, columns)) for n, c in outputs.items()])


def small(df: DataFrame, rows: int = BROADCAST_IDS, text: Column | None = None) -> DataFrame:
    """``df``, a written table, with a broadcast hint if it is counted and has no more than ``rows`` rows.

    Where rows carry a ``text``, all of these may have ``BROADCAST_TEXT`` bytes at most.
    """
    size = F.octet_length(text) if text is not None else F.lit(0)
    found = df.agg(F.count("*").alias("rows"), F.sum(size.cast("long")).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= rows and (found["bytes"] or 0) <= BROADCAST_TEXT else df
