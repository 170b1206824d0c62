"""Data tests. Every test gives rows (test, model, column, status, failures); status is pass, warn or fail."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _status(failures: Column, severity: str) -> Column:
    return F.when(failures == 0, "pass").otherwise("warn" if severity == "warn" else "fail")


def _result(df: DataFrame, test: str, model: str, column: str, severity: str = "error") -> DataFrame:
    """From a frame of one row with failures."""
    return df.select(F.lit(test).alias("test"), F.lit(model).alias("model"), F.lit(column).alias("column"), _status(F.col("failures"), severity).alias("status"), F.col("failures").cast("long").alias("failures"))


def not_null(df: DataFrame, model: str, column: str, severity: str = "error") -> DataFrame:
    return _result(df.agg(F.count_if(F.col(column).isNull()).alias("failures")), "not_null", model, column, severity)


def unique(df: DataFrame, model: str, columns: Sequence[str], severity: str = "error") -> DataFrame:
    """Failures are keys that occur more than once; keys with a null are ignored."""
    repeated = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
    return _result(repeated.agg(F.count("*").alias("failures")), "unique", model, ",".join(columns), severity)


def unique_keys(df: DataFrame, model: str, keys: Sequence[Sequence[str]], severity: str = "error") -> DataFrame:
    """``unique`` for several keys at once: rows are grouped by all of them in one scan and one shuffle, as grouping sets."""
    keys = list(dict.fromkeys(tuple(k) for k in keys))
    columns = list(dict.fromkeys(c for k in keys for c in k))
    # Keys and columns by names of our own, since a set's bits follow the order of the columns.
    named = {c: f"key{i}" for i, c in enumerate(columns)}
    slim = df.select(*[F.col(c).alias(n) for c, n in named.items()])
    grouped = slim.groupingSets([[F.col(named[c]) for c in k] for k in keys], *named.values()).agg(F.grouping_id(*named.values()).alias("of"), F.count("*").alias("n"))

    def failures(key: Sequence[str]) -> Column:
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in key)
        whole = functools.reduce(lambda a, b: a & b, [F.col(named[c]).isNotNull() for c in key])
        return F.count_if((F.col("of") == bits) & (F.col("n") > 1) & whole)

    rows = [F.struct(F.lit("unique").alias("test"), F.lit(model).alias("model"), F.lit(",".join(k)).alias("column"), _status(failures(k), severity).alias("status"), failures(k).cast("long").alias("failures")) for k in keys]
    return grouped.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def rejected_values(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """(value, n) of values that are not accepted; nulls are accepted."""
    return df.filter(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def accepted_values(df: DataFrame, model: str, column: str, values: Sequence[object], severity: str = "error") -> DataFrame:
    """Failures are rows whose value is not accepted."""
    return _result(df.agg(F.count_if(~F.col(column).isin(*values)).alias("failures")), "accepted_values", model, column, severity)


def relationships(child: DataFrame, model: str, column: str, parent: DataFrame, parent_column: str, severity: str = "error") -> DataFrame:
    """Failures are rows whose key is not null and not among the parent's."""
    orphans = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")
    return _result(orphans.agg(F.count("*").alias("failures")), "relationships", model, column, severity)


def not_empty(df: DataFrame, model: str) -> DataFrame:
    """Fails when there are no rows."""
    return _result(df.agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("failures")), "not_empty", model, "")


@dataclass(frozen=True)
class Check:
    """A column check of a suite: not_null, or accepted_values with values."""

    test: str
    column: str
    values: tuple = ()
    severity: str = "error"


def run_suite(df: DataFrame, model: str, checks: Sequence[Check], keys: Sequence[Sequence[str]] = ()) -> DataFrame:
    """All column checks in one aggregation of the table, and uniqueness tests of all ``keys`` in another, turned to rows."""
    fails = [F.count_if(F.col(c.column).isNull() if c.test == "not_null" else ~F.col(c.column).isin(*c.values)) for c in checks]
    rows = [F.struct(F.lit(c.test).alias("test"), F.lit(model).alias("model"), F.lit(c.column).alias("column"), _status(n, c.severity).alias("status"), n.cast("long").alias("failures")) for c, n in zip(checks, fails)]
    wide = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return wide.unionByName(unique_keys(df, model, keys)) if keys else wide


def assertion(failure_type: str, found: DataFrame, keys: Sequence[str], detail: Column, description: str) -> DataFrame:
    """Rows that break one rule, in the shape that all rules share."""
    return found.select(F.lit(failure_type).alias("failure_type"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("keys"), detail.cast("string").alias("detail"), F.lit(description).alias("description"))


def row_assertions(df: DataFrame, rules: Sequence[tuple[str, Column, Sequence[str], Column, str]]) -> DataFrame:
    """Assertions on the rows of one frame in one pass: (failure type, what breaks the rule, keys, detail, description) each."""
    shape = lambda name, keys, detail, said: F.struct(F.lit(name).alias("failure_type"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("keys"), detail.cast("string").alias("detail"), F.lit(said).alias("description"))
    found = F.array(*[F.when(broken, shape(name, keys, detail, said)) for name, broken, keys, detail, said in rules])
    return df.select(F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("f.*")


def all_assertions(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of assertions; no rows means that all hold."""
    return functools.reduce(DataFrame.unionByName, parts)


def roll_up(results: DataFrame) -> DataFrame:
    """Tests by status."""
    return results.groupBy("status").agg(F.count("*").alias("tests"), F.sum("failures").alias("failures"))
