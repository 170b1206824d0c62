"""Sources and sinks: seeds, external files, materialisation, incremental updates, history and exports."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line, typed by ``schema``; a byte-order mark before the header is no part of a value."""
    return spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).schema(schema).csv(path)


def read_external(spark: SparkSession, template: str, identifier: str = "") -> DataFrame:
    """Reads the file or glob that ``template`` names once ``{identifier}`` is put in; the ending tells the format."""
    path = template.replace("{identifier}", identifier)
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)


def materialize(df: DataFrame, name: str, kind: str = "view", path: str | None = None) -> DataFrame:
    """Registers ``df`` as a temporary view, or writes it as a table (replacing it) and returns it by name.

    A table lies at ``path`` if that is given, else in the warehouse.
    """
    if kind == "table":
        writer = df.write.mode("overwrite")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def upsert(target: DataFrame, changes: DataFrame, unique_key: str | Sequence[str], full_refresh: bool = False) -> DataFrame:
    """Rows of ``target`` whose key is not among ``changes``, and all of ``changes``. A full refresh keeps only these."""
    if full_refresh:
        return changes
    keys = [unique_key] if isinstance(unique_key, str) else list(unique_key)
    return target.join(changes.select(*keys).distinct(), keys, "left_anti").select(*target.columns).unionByName(changes)


def snapshot_scd2(history: DataFrame, current: DataFrame, key: str, check: Sequence[str], as_of: Column) -> DataFrame:
    """History with valid_from and valid_to after seeing ``current`` at ``as_of``.

    Open rows whose checked columns changed, or whose key is gone, are closed; changed and new keys open a row. Closed
    rows stay. Nulls are equal to nulls.
    """
    open_, closed = history.filter("valid_to IS NULL"), history.filter("valid_to IS NOT NULL")
    now = current.select(key, *check)
    o, c = open_.alias("o"), now.alias("c")
    both = o.join(c, F.col(f"o.{key}") == F.col(f"c.{key}"), "full_outer")
    same = functools.reduce(operator.and_, [F.col(f"o.{x}").eqNullSafe(F.col(f"c.{x}")) for x in check], F.lit(True))
    old = both.filter(F.col(f"o.{key}").isNotNull())
    ends = F.when(F.col(f"c.{key}").isNotNull() & same, F.lit(None)).otherwise(as_of)
    kept = old.select(*[F.col(f"o.{x}") for x in [key, *check]], F.col("o.valid_from"), ends.alias("valid_to"))
    new = both.filter(F.col(f"o.{key}").isNull() | (F.col(f"c.{key}").isNotNull() & ~same)).select(*[F.col(f"c.{x}") for x in [key, *check]], as_of.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    return closed.select(key, *check, "valid_from", "valid_to").unionByName(kept).unionByName(new)


def export_dated_parquet(df: DataFrame, folder: str, name: str, date: str) -> str:
    """Writes ``folder/name_date`` and returns the path."""
    path = f"{folder}/{name}_{date}"
    df.write.mode("overwrite").parquet(path)
    return path


def _texts(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]


def _headed(df: DataFrame, *header: str) -> DataFrame:
    """``df`` of text lines after the ``header`` lines."""
    first = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(h) for h in header])).alias("line"))
    return first.unionByName(df)


def export_delimited(df: DataFrame, fmt: str = "csv", header: bool = True) -> DataFrame:
    """A header line and one text line per row. CSV quotes what holds a comma, quote or line end and doubles quotes; TSV turns
    tabs into spaces.
    """
    if fmt == "tsv":
        lines = df.select(F.concat_ws("\t", *[F.regexp_replace(c, "\t", " ") for c in _texts(df)]).alias("line"))
        return _headed(lines, "\t".join(c.replace("\t", " ") for c in df.columns)) if header else lines
    quoted = [F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in _texts(df)]
    names = ['"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in df.columns]
    lines = df.select(F.concat_ws(",", *quoted).alias("line"))
    return _headed(lines, ",".join(names)) if header else lines


def export_markdown(df: DataFrame, header: bool = True) -> DataFrame:
    """A header line, a line of dashes, and one ``| a | b |`` line per row with pipes escaped."""
    cells = [F.replace(c, F.lit("|"), F.lit("\\|")) for c in _texts(df)]
    lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return _headed(lines, f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |") if header else lines


def export_json(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct("*")).alias("line"))


def preview(df: DataFrame, limit: int = 500) -> DataFrame:
    """At most ``limit`` rows; -1 means all."""
    return df if limit < 0 else df.limit(limit)
