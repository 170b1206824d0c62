"""Sorting out, unions and multiset differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most frequent values; ties in order of value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(n)


def with_unknown_row(df: DataFrame, **values: object) -> DataFrame:
    """``df`` and one more row; columns not named are null."""
    row = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(row)
