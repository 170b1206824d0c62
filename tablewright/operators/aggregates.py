"""Aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.windows import counts_before
from tablewright.plans.scratch import Scratch


#: Rows of a group up to which one task may hold its distinct values.
GROUP_ROWS = 1 << 20


def interval_summary(df: DataFrame, keys: Sequence[str], value: str, scratch: Scratch | None = None, low: float = 0.05, high: float = 0.95, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Mean and two percentiles by key. With ``scratch`` they are exact; else a sketch of bounded size answers.

    Exact ones interpolate between the values at the two places around each percentile. Where the largest group has more than
    ``group_rows`` rows, places come from counts of distinct values in ranges, so no task holds a key's values; below, one
    aggregation gives the same numbers. Null values are left out; a key without any has nulls.
    """
    if scratch is None:
        return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile_approx(value, low).alias("low"), F.percentile_approx(value, high).alias("high"))
    largest = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= group_rows:
        return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"))
    slim = scratch.table(df.select(*keys, value), "values")
    placed = scratch.table(counts_before(slim.filter(F.col(value).isNotNull()), keys, value, scratch), "places")
    total = scratch.table(slim.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n")), "totals").alias("t")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    at = lambda q: (F.col("n") - 1) * q
    here = lambda place: F.when((F.col("before") <= place) & (F.col("before") + F.col("rows") > place), F.col(value))
    ends = [f(at(q)) for q in (low, high) for f in (F.floor, F.ceil)]
    found = placed.alias("p").join(total, same, "right").groupBy(*[F.col(f"t.{k}").alias(k) for k in keys]).agg(F.first("mean").alias("mean"), F.first("n").alias("n"), *[F.max(here(e)).alias(f"v{i}") for i, e in enumerate(ends)])
    between = lambda a, b, q: F.col(a) + (F.col(b) - F.col(a)) * (at(q) - F.floor(at(q)))
    return found.select(*keys, "mean", between("v0", "v1", low).alias("low"), between("v2", "v3", high).alias("high"))


def latest_value(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that hold their key's maximum of ``order``, ties kept."""
    return df.join(df.groupBy(key).agg(F.max(order).alias(order)), [key, order], "left_semi")


def nothing_found(df: DataFrame, condition: Column) -> DataFrame:
    """One row (n = 0) if no row meets the condition, else none."""
    return df.filter(condition).agg(F.count("*").alias("n")).filter("n = 0")


def selection_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, total, mean) of chosen columns; what is no number is left out. One pass, then a turn to long form."""
    from tablewright.functions.exprs import safe_num

    parts = [F.struct(F.lit(c).alias("column"), F.count(safe_num(F.col(c))).alias("n"), F.sum(safe_num(F.col(c))).alias("total"), F.avg(safe_num(F.col(c))).alias("mean")) for c in columns]
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def ordered_text(value: str, *order: str) -> Column:
    """Values joined by a comma in order, the order being that of ``order`` and then the value."""
    rows = F.sort_array(F.collect_list(F.struct(*order, value)))
    return F.array_join(F.transform(rows, lambda r: r[value].cast("string")), ",")
