"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.plans.scratch import Scratch

#: Characters of text that a sample has at most, beside its bound on rows; so the driver's share is bounded too.
SAMPLE_CHARS = 1 << 26


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, rows: int, allowed: Column | None = None, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, grade) of at most ``rows`` labelled documents of ``chars`` characters in all, by the hash of their id.

    The bounds are the only cuts: they hold at every size, and the same rows come whatever the partitioning. Where the texts
    chosen have more than ``chars`` characters, the longest of them are left out and no others. Rows with a null id, a null grade or
    ``allowed`` not true are no labels; a document labelled more than once takes its least grade. Of repeated
    documents the least text is used.
    """
    usable = labels.filter(F.col("doc_id").isNotNull()).filter(allowed if allowed is not None else F.lit(True))
    graded = usable.select(F.col("doc_id").cast("long"), grade.cast("int").alias("grade")).filter("grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    # Some labelled ids may lack a document; those with one are found before the bound applies.
    met = graded.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    few = met.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    sample = Scratch(docs.sparkSession, "labelled").table(sample, "sample")
    # At most ``rows`` lengths: one small task.
    so_far = F.sum("n").over(Window.orderBy("n", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = sample.select("doc_id", F.char_length("text").cast("long").alias("n")).withColumn("so_far", so_far).filter(F.col("so_far") <= chars).select("doc_id")
    return sample.join(F.broadcast(inside), "doc_id").orderBy("doc_id")
