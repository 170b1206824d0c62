"""Corpus preparation in five written stages; each one reads all that its predecessor kept.

classify quality, apply quality rules, drop near duplicates, mix sources to target weights, encode. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.bpe import round_trip
from tablewright.llm.columns import free_name, own, packed, small, unpacked
from tablewright.llm.mixing import mix
from tablewright.llm.near_dedup import near_duplicates
from tablewright.llm.quality_classifier import classify
from tablewright.llm.quality_rules import judge
from tablewright.plans.scratch import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of at least a sound grade is one half or more.

    Null and empty texts are scored as the empty text, very long ones whole. Repeated rows are judged alike and stay or go
    together. Columns may have any name. An empty table gives none; without labels every document stays.
    """
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(F.col(free_name("quality_kept", docs.columns))).select(*own(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and are no outliers of their language and source.

    Null, empty and blank texts fail the counting rules and go. Null lang and source are values of their own. Repeated
    rows each count and are judged alike. Columns may have any name. An empty table gives none.
    """
    judged = judge(docs, Scratch(spark, "rules"))
    return judged.filter(F.col(free_name("quality_ok", docs.columns))).select(*own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles at a similarity of 0.8: the smallest doc_id.

    Rows without an id and texts without words stay. Of repeated rows of the smallest doc_id one stays; other texts under
    that id stay too. Columns may have any name. An empty table gives none.

    Ids that go, and ids that repeat, are fewer than documents and are broadcast to these behind a count; so texts stay
    where they are but for the rows of repeated ids.
    """
    scratch = Scratch(spark, "near")
    found = scratch.table(near_duplicates(docs, scratch, width=5, percent=80).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "found")
    gone = small(scratch.table(found.filter("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("gone_id")), "gone"))
    often = small(scratch.table(found.filter("doc_id IS NOT NULL AND kept AND rows > 1").select(F.col("doc_id").alias("often_id")), "often"))
    rows = packed(docs, F.col("doc_id").cast("long").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    stay = rows.join(gone, F.col("id") == F.col("gone_id"), "left_anti")
    once = stay.join(often, F.col("id") == F.col("often_id"), "left_anti").select("row")
    repeated = stay.join(often, F.col("id") == F.col("often_id"), "left_semi").dropDuplicates(["id", "text_md5"]).select("row")
    return unpacked(once.unionByName(repeated), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have size 0 and follow their source's rate; a null source is a source of its own. Repeated rows
    draw alike. Columns may have any name. An empty table gives none.
    """
    return mix(docs, Scratch(spark, "mix"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document taken.

    A null text is the empty one, which has no ids. Repeated rows each give a row; other columns are ignored. An empty table
    gives none.
    """
    return round_trip(docs.select("doc_id", "text"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("minhash_near_dedup", near_dedup), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]
#: A fitted classifier and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = scratch.table(stage(spark, docs, sf_dir), name)
        docs = done
    return docs
