"""Mixing sources to target weights.

Tokens are summed per source, the token budget is dealt by weight under a cap per source, and each document is emitted
floor(rate) times plus once more by a Bernoulli draw whose probability is the rate's fraction. The draw is a hash of
the document's id and a seed, so any rerun and any partitioning emits the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.columns import free_name, own, packed, small, unpacked
from tablewright.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that are broadcast at most; more are joined by a shuffle.
SOURCES = 100_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with rank from 0 by code point of source, null last, without one task that holds all of them.

    Rows are cut into ordered ranges, ranked within their range and shifted by the rows of the ranges before it.
    """
    order = [F.col("source").asc_nulls_last()]
    dealt = scratch.table(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return inside.join(before.select("part", "before"), "part").withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "before", "place")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target tokens of each source (columns source, source_size in; weight and target added).

    The budget, ``share`` times all tokens, is dealt by weight. A source above ``cap`` times its size stops there and the
    excess is dealt again among the others, until none is above. Each round reads three sums of the source table.
    With nothing to deal, targets are 0.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = scratch.table(ranked(sizes, scratch).withColumn("weight", pick), "sources")
    limit = F.col("source_size") * float(cap)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        open_ = limit >= F.lit(level) * F.col("weight")
        row = table.agg(F.sum(F.when(~open_, F.col("source_size"))).alias("full"), F.sum(F.when(open_, F.col("weight"))).alias("w"), F.count_if(~open_).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        capped = row["n"]
        level = (float(share) * total - float(cap) * (row["full"] or 0)) / row["w"]
    return table.withColumn("target", F.least(limit, F.lit(level) * F.col("weight"))).select("source", "source_size", "weight", "target")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1): 52 bits of an MD5 of seed and id; rows without an id are told apart by their text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") / float(2**52)


def with_copies(docs: DataFrame, scratch: Scratch, seed: str = "mix", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    Needs doc_id, text and source; keeps all other columns. Null and empty texts have size 0 and are emitted as their
    source's rate says; very long texts are counted whole. Repeated rows draw alike. Null is a source of its own. An empty
    table gives no rows. Where ``docs`` has a column named like an output, that output has an underscore after its name.
    """
    draws = draw(F.col("doc_id"), F.col("text"), seed)
    sized = packed(docs, F.col("source").alias("source"), word_count(F.col("text")).alias("size"), draws.alias("draw"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, scratch, weights, share, cap).select(F.col("source").alias("mix_source"), "source_size", "target")
    targets = small(scratch.table(targets, "targets"), SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    once_more = (F.col("draw") < rate - F.floor(rate)).cast("int")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source")), "left")
    return unpacked(joined, docs.columns, mix_size=F.col("size"), mix_source_size=F.col("source_size"), mix_target=F.col("target"), mix_copies=(F.floor(rate) + once_more).cast("int"))


def mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    chosen = with_copies(docs, scratch, **options)
    copies = F.col(free_name("mix_copies", docs.columns))
    times = F.explode(F.sequence(F.lit(1), copies)).alias(free_name("mix_copy", docs.columns))
    return chosen.filter(copies > 0).select(*own(docs), times).select(*own(docs))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = with_copies(docs, Scratch(spark, "mix"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP9_SQL = r"""
WITH s AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS place, sum(source_size) OVER () AS total FROM w),
c AS (SELECT *, (1.5 * total - 2.0 * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
l AS (SELECT arg_min(level, place) FILTER (2.0 * source_size >= level * weight) AS level FROM c),
t AS (SELECT source, source_size, least(2.0 * source_size, l.level * weight) AS target FROM c, l)
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN source_size > 0 THEN floor(target / source_size) +
         CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0
                   < target / source_size - floor(target / source_size) THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
"""
