"""Column expressions whose meaning differs between engines, predicates, and a filter mini-language."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def int_round(c: Column) -> Column:
    """Integer cast that rounds half to even, where Spark's own cast cuts off."""
    return F.bround(c, 0).cast("int")


def parse_us_date(c: Column) -> Column:
    """``Tue Oct 24 2023`` to a date; the week day is dropped since Spark does not parse it. Null for other text."""
    return F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM d yyyy")).cast("date")


def safe_num(c: Column) -> Column:
    """Double of a value that may hold thousands commas; null for what is no number."""
    return F.regexp_replace(c.cast("string"), ",", "").try_cast("double")


def clean_string(c: Column) -> Column:
    """Trimmed text; empty text and the word NULL become null."""
    t = F.trim(c)
    return F.when((t == "") | (F.upper(t) == "NULL"), None).otherwise(t)


def status_bucket(c: Column, mapping: dict[str, str], other: str = "other") -> Column:
    """Maps statuses, compared in lower case, to buckets."""
    out = F.lit(other)
    for value, bucket in mapping.items():
        out = F.when(F.lower(c) == value.lower(), bucket).otherwise(out)
    return out


def completed(status: Column, values: Sequence[str]) -> Column:
    return status.isin(*values)


def recent(day: Column, since: str) -> Column:
    return day >= F.to_timestamp(F.lit(since))


def tail(mode: str, *predicates: Column) -> Column:
    """Predicates joined by ``and`` (mode where/and) or by ``or``."""
    return functools.reduce(operator.or_ if mode == "or" else operator.and_, predicates)


def filter_dsl(df: DataFrame, text: str) -> Column:
    """One predicate from ``column: test``, or a search over all columns from bare text.

    Tests are ``>n``, ``<n``, ``>=n``, ``<=n`` (numbers, commas allowed), ``= v``, ``== v``, ``!= v``, ``<> v``, ``= null``,
    ``!= null`` and ``contains x``; anything else is contained text, as is ``=v`` without a space. Text compares
    without regard to case.
    """
    by_name = {c.lower(): c for c in df.columns}
    m = re.fullmatch(r"\s*([^:]+?)\s*:\s*(.*?)\s*", text, re.S)
    if not m or m[1].lower() not in by_name:
        return any_contains(df, text.strip())
    c, test = F.col(f"`{by_name[m[1].lower()]}`"), m[2]
    as_text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    if n := re.fullmatch(r"(>=|<=|>|<)\s*(-?[\d,]*\.?\d+)", test):
        compare = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}[n[1]]
        return F.coalesce(compare(safe_num(c), F.lit(float(n[2].replace(",", "")))), F.lit(False))
    if n := re.fullmatch(r"(==|=|!=|<>)\s+(.*)", test):
        value, equal = n[2].lower(), n[1] in ("=", "==")
        hit = c.isNull() | (as_text == "") if value == "null" else as_text == value
        return hit if equal else ~hit
    needle = re.sub(r"^contains\s+", "", test, flags=re.I).lower()
    return F.contains(as_text, F.lit(needle))


def any_contains(df: DataFrame, text: str) -> Column:
    """Whether any column, as text in lower case, contains ``text``."""
    hits = [F.contains(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(text.lower())) for c in df.columns]
    return functools.reduce(operator.or_, hits, F.lit(False))


def search_all(df: DataFrame, text: str) -> DataFrame:
    return df.filter(any_contains(df, text))


def eval_expression(step: DataFrame, expression: str, name: str = "value") -> DataFrame:
    """Any scalar or aggregate expression over an intermediate step."""
    return step.selectExpr(f"{expression} AS `{name}`")


def stops_at(step: DataFrame, expression: str) -> bool:
    """A stop condition: the truth of the expression in the step's first row, false without rows."""
    row = step.selectExpr(f"{expression} AS stop").first()
    return bool(row and row["stop"])


def create_is_positive_int(spark: SparkSession) -> None:
    """Registers the SQL function is_positive_int(text)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_positive_int(a STRING) RETURNS BOOLEAN RETURN coalesce(try_cast(a AS INT) > 0, false)")


def sort_nulls_last(df: DataFrame, column: str, ascending: bool = True, *ties: str) -> DataFrame:
    """Nulls last both ways; values that are numbers compare as numbers and come before those that are not."""
    number, text = safe_num(F.col(column)), F.col(column).cast("string")
    keys = [number.asc_nulls_last(), text.asc_nulls_last()] if ascending else [number.desc_nulls_last(), text.desc_nulls_last()]
    return df.orderBy(*keys, *[F.col(t).asc_nulls_last() for t in ties])
