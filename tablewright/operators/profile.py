"""Column profiles over whole tables, each in one scan."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRUE_TEXTS, FALSE_TEXTS = ("true", "t", "yes", "1"), ("false", "f", "no", "0")


def _long(df: DataFrame, parts: Sequence[Column]) -> DataFrame:
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def is_blank(c: Column) -> Column:
    """Null or empty text."""
    return c.isNull() | (c.cast("string") == "")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, total, nulls, null_percent) of every column; empty text counts as null."""
    blank = lambda c: F.count_if(is_blank(F.col(f"`{c}`")))
    share = lambda c: F.coalesce(F.round(F.try_divide(blank(c) * 100.0, F.count("*")), 2), F.lit(0.0))
    return _long(df, [F.struct(F.lit(c).alias("column"), F.count("*").alias("total"), blank(c).alias("nulls"), share(c).alias("null_percent")) for c in df.columns])


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    x = lambda c: F.col(c).cast("double")
    return _long(df, [F.struct(F.lit(c).alias("column"), F.min(x(c)).alias("min"), F.max(x(c)).alias("max"), F.round(F.avg(x(c)), 2).alias("mean")) for c in columns])


def histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """(bucket, n) of equal widths from least to greatest value; a constant column falls into bucket 0."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("width", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0))
    at = F.least(F.lit(buckets - 1), F.floor((F.col("x") - F.col("lo")) / F.col("width") * buckets)).cast("int")
    return x.crossJoin(F.broadcast(ends)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))


def boolean_profile(df: DataFrame, column: str) -> DataFrame:
    t = F.lower(F.col(column).cast("string"))
    yes, filled = F.count_if(t.isin(*TRUE_TEXTS)), F.count_if(~is_blank(F.col(column)))
    return df.agg(yes.alias("trues"), (filled - yes).alias("falses"), F.round(F.try_divide(yes * 100.0, filled), 2).alias("true_percent"))


def date_profile(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).cast("string").alias("first"), F.max(column).cast("string").alias("last"))


def text_profile(df: DataFrame, columns: Sequence[str], top: int = 5, exact: bool = True) -> DataFrame:
    """(column, distinct_values, value, n): the most frequent values of each column, ties in order of value.

    Values are counted before they are ranked, so the window sees distinct values only.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    n = df.select(pairs.alias("p")).select("p.*").filter(~is_blank(F.col("value"))).groupBy("column", "value").agg(F.count("*").alias("n"))
    distinct = n.groupBy("column").agg((F.count("*") if exact else F.approx_count_distinct("value")).alias("distinct_values"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    best = n.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    return best.join(distinct, "column").select("column", "distinct_values", "value", "n")


def inferred_types(df: DataFrame, order: str, sample: int = 50, share: float = 0.8) -> DataFrame:
    """(column, kind) of text columns from the first rows by ``order``: over ``share`` must look alike.

    Boolean is tried first, then number, then date, and text is what remains.
    """
    few = df.orderBy(order).limit(sample)
    patterns = {"boolean": r"(?i)^(true|false|t|f|yes|no)$", "number": r"^-?[\d,]*\.?\d+$", "date": r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"}

    def kind(c: str) -> Column:
        filled = F.count_if(~is_blank(F.col(c)))
        rate = lambda p: F.try_divide(F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(p)), filled)
        return functools.reduce(lambda other, k: F.when(rate(patterns[k]) > share, k).otherwise(other), reversed(patterns), F.lit("string"))

    return _long(few, [F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in df.columns])
