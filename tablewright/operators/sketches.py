"""Column profiles from stored sketches: a small state per period, key and column, merged for whatever range is asked for.

Numbers keep a quantile sketch, texts a distinct-count sketch and a frequent-items sketch, beside plain sums; all are Spark's own
aggregates. States are stored in folders by period: a period that changes is scanned and replaced alone, and a profile over
many periods reads states only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches: items of a level of the quantile sketch, log2 of the registers that count distinct values, and values tracked.
QUANTILE_K, DISTINCT_LG, TRACKED = 400, 12, 1024
#: Ranks that a histogram is read from.
GRID = 512


def rank_error(k: int = QUANTILE_K) -> float:
    """How far the rank of an estimated quantile lies from the one asked for, in 99% of cases: 2.296 / k**0.9021."""
    return 2.296 / k**0.9021


def distinct_error(lg: int = DISTINCT_LG) -> float:
    """Relative standard error of a distinct count; counts of a few hundred are exact but for rounding."""
    return 0.83 / 2 ** (lg / 2)


def count_error(rows: int, tracked: int = TRACKED) -> float:
    """How far a frequent value's count may be off at most; nothing while there are no more than ``tracked`` values."""
    return 3.5 * rows / tracked


def _states(df: DataFrame, keys: Sequence[str], parts: Sequence[Column]) -> DataFrame:
    """A row for each group and column from one aggregation."""
    return df.groupBy(*keys).agg(F.array(*parts).alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")


def number_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """(keys, column, n, nulls, least, greatest, total, quantiles) of number columns."""

    def state(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.sum(x).alias("total"), F.kll_sketch_agg_double(x, k).alias("quantiles"))

    return _states(df, keys, [state(c) for c in columns])


def text_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lg: int = DISTINCT_LG, tracked: int = TRACKED) -> DataFrame:
    """(keys, column, n, nulls, distinct, frequent) of text columns; empty texts count as nulls."""

    def state(c: str) -> Column:
        x = F.nullif(F.col(c).cast("string"), F.lit(""))
        # The map holds three quarters of its size.
        top = F.call_function("approx_top_k_accumulate", x, F.lit(tracked * 4 // 3))
        return F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.hll_sketch_agg(x, lg).alias("distinct"), top.alias("frequent"))

    return _states(df, keys, [state(c) for c in columns])


def store_states(states: DataFrame, path: str, period: str) -> None:
    """Writes states in folders by ``period``; periods that ``states`` has none of stay as they are."""
    states.repartition(period).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def merged_numbers(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """States of number columns merged to ``keys``, which may be fewer than they were kept by."""
    held = F.when(F.col("n") > 0, F.col("quantiles"))
    return states.groupBy(*keys, "column").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"), F.kll_merge_agg_double(held).alias("quantiles"))


def number_profile(states: DataFrame, keys: Sequence[str] = (), at: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(keys, column, n, nulls, least, greatest, mean, quantiles) with an estimate for each rank of ``at``; null without values."""
    ranks = F.array(*[F.lit(float(q)) for q in at])
    estimate = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", ranks))
    return merged_numbers(states, keys).select(*keys, "column", "n", "nulls", "least", "greatest", F.try_divide("total", "n").alias("mean"), estimate.alias("quantiles"))


def histogram_from_states(states: DataFrame, keys: Sequence[str] = (), buckets: int = 10) -> DataFrame:
    """(keys, column, bucket, n) of equal widths from least to greatest.

    Read off the quantiles of ``GRID`` ranks; each n is off by twice the rank error and two steps of the grid at most.
    """
    merged = merged_numbers(states, keys).filter("n > 0")
    width = F.when(F.col("greatest") > F.col("least"), F.col("greatest") - F.col("least")).otherwise(1.0) / buckets
    grid = F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))
    # What lies below a bucket's lower end, as a share; the last bucket holds the greatest value.
    below = lambda i: F.when(i >= buckets, 1.0).otherwise(F.size(F.filter("grid", lambda v: v < F.col("least") + F.col("width") * i)) / GRID)
    counts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.round(F.col("n") * (below(i + 1) - below(i))).cast("long"))
    return merged.withColumns({"grid": grid, "width": width}).select(*keys, "column", F.posexplode(counts).alias("bucket", "n"))


def text_profile_from_states(states: DataFrame, keys: Sequence[str] = (), top: int = 5, tracked: int = TRACKED) -> DataFrame:
    """(keys, column, n, nulls, distinct_values, value, value_n): the most frequent values, ties in order of value.

    Columns without values have none.
    """
    combined = F.call_function("approx_top_k_combine", F.when(F.col("n") > 0, F.col("frequent")), F.lit(tracked * 4 // 3))
    merged = states.filter("n > 0").groupBy(*keys, "column").agg(F.hll_union_agg("distinct").alias("distinct"), combined.alias("frequent"))
    sums = states.groupBy(*keys, "column").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"))
    # All values tracked, so that ties at the end are cut by value; null is tracked as one of them.
    found = F.filter(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(tracked)), lambda f: f["item"].isNotNull())
    best = F.slice(F.sort_array(F.transform(found, lambda f: F.struct((-f["count"]).alias("order"), f["item"].alias("value")))), 1, top)
    rows = merged.select(*keys, "column", F.hll_sketch_estimate("distinct").alias("distinct_values"), F.explode(best).alias("b"))
    return sums.join(rows, [*keys, "column"]).select(*keys, "column", "n", "nulls", "distinct_values", F.col("b.value").alias("value"), (-F.col("b.order")).alias("value_n"))
