"""Exact top-k search by inner product over a pivot-distance index.

Inner product becomes a metric by one more coordinate: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0)
give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest are the highest scores. Vectors are keyed by their nearest pivot and
their distance to it, sorted, and cut into annuli of bounded size. By the triangle inequality an annulus [lo, hi] of
pivot p holds nothing nearer to q than |d(q, p) - [lo, hi]|. A first pass reads the annuli on both sides of a query's place
in the order of each of its nearest pivots, which bounds its k-th distance; the second goes outward from there as far
as that bound, and what lies beyond it is left unread. Queries find annuli by cells of a pivot's distances, so only
pairs that are read are formed. Scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.columns import small
from tablewright.plans.scratch import Scratch

SCALE = 1024
#: Pivots are the vectors with the smallest hash of their id: a sample that grows with the root of their number, in these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 32, 1024
#: Pivots beside whose annuli a query starts.
NEAR_PIVOTS = 4
#: Vectors in an annulus, and queries in a block.
ANNULUS, QUERY_BLOCK = 512, 128
LONG_MAX = 2**63 - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) with x an array of floor(SCALE * component) as double; rows that may not take part are left out.

    Left out: null ids, null vectors, and vectors with a null, infinite or NaN component. Components beyond 64 bits
    saturate.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    usable = v.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(F.forall("e", lambda x: F.coalesce(finite(x), F.lit(False))))
    return usable.select("vec_id", F.transform("e", lambda x: F.floor(x * SCALE).cast("double")).alias("x"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which changes no inner product."""
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes all of norm ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``x`` to ``pivots``."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products. Doubles carry them up to 2^53; beyond, Python's integers do, cut to 64 bits."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], dtype=object) @ np.array([[int(v) for v in row] for row in x], dtype=object).T
    return np.clip(whole, -LONG_MAX - 1, LONG_MAX).astype(np.int64)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -score))[:k]


class Index:
    """Annuli of all vectors: table blocks(block, pivot, lo, hi, n, ids, xs), the pivots, the widest vector and norm."""

    def __init__(self, vectors: DataFrame, scratch: Scratch, pivots: int | None = None, annulus: int = ANNULUS):
        self.scratch, self.annulus = scratch, annulus
        vectors = scratch.table(vectors, "vectors")
        shape = vectors.agg(F.max(F.size("x")).alias("width"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).alias("top"), F.count("*").alias("n")).first()
        self.width, self.top, self.n = max(1, shape["width"] or 0), (shape["top"] or 0.0), shape["n"]
        pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(self.n) // 8))
        picked = vectors.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toPandas()
        self.pivots = lifted(matrix(picked.x, self.width), self.top)
        self.vectors = vectors
        self.blocks = self._blocks() if self.n else None

    def _blocks(self) -> DataFrame:
        width, top, centres, most = self.width, self.top, self.pivots, self.annulus

        def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                d = distances(lifted(matrix(pdf.x, width), top), centres)
                near = d.argmin(1)
                yield pd.DataFrame({"vec_id": pdf.vec_id, "pivot": near.astype(np.int32), "distance": d[np.arange(len(near)), near], "x": pdf.x})

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for pivot, part in pdf.groupby("pivot", sort=False):
                    for i in range(0, len(part), most):
                        a = part.iloc[i : i + most]
                        xs = matrix(a.x, width)
                        yield pd.DataFrame({"pivot": [pivot], "lo": [a.distance.min()], "hi": [a.distance.max()], "n": [len(a)], "ids": [a.vec_id.to_numpy()], "xs": [xs.tobytes()]})

        keyed = self.scratch.table(self.vectors.mapInPandas(key, "vec_id long, pivot int, distance double, x array<double>"), "keyed")
        # The id makes even a vector that fills a third of the table fall into many ranges.
        ranges = max(1, math.ceil(self.n / (8 * most)))
        dealt = keyed.repartitionByRange(ranges, "pivot", "distance", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "distance")
        cuts = dealt.mapInPandas(cut, "pivot int, lo double, hi double, n int, ids array<long>, xs binary")
        out = self.scratch.table(cuts.withColumn("block", F.monotonically_increasing_id()), "annuli")
        self.scratch.drop(keyed)
        return out


def _query_blocks(index: Index, queries: DataFrame) -> DataFrame:
    """(qblock, qids, qs) with queries near each other in one block: sorted by nearest pivot and distance."""
    width, top, centres = index.width, index.top, index.pivots

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = distances(np.hstack([matrix(pdf.x, width), np.zeros((len(pdf), 1))]), centres)
            near = d.argmin(1)
            yield pd.DataFrame({"vec_id": pdf.vec_id, "pivot": near.astype(np.int32), "distance": d[np.arange(len(near)), near], "x": pdf.x})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), QUERY_BLOCK):
                a = pdf.iloc[i : i + QUERY_BLOCK]
                yield pd.DataFrame({"qids": [a.vec_id.to_numpy()], "qs": [matrix(a.x, width).tobytes()]})

    keyed = index.scratch.table(queries.mapInPandas(key, "vec_id long, pivot int, distance double, x array<double>"), "query-keys")
    ranges = max(1, math.ceil(index.n / 100 / (4 * QUERY_BLOCK)))
    dealt = keyed.repartitionByRange(ranges, "pivot", "distance", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "distance")
    return index.scratch.table(dealt.mapInPandas(cut, "qids array<long>, qs binary").withColumn("qblock", F.monotonically_increasing_id()), "query-blocks")


def _starts(index: Index, blocks: DataFrame) -> DataFrame:
    """(qblock, pivot, at): the pivots nearest to a block's queries and its mean distance to each."""
    width, centres = index.width, index.pivots

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q = np.frombuffer(r.qs).reshape(-1, width)
                d = distances(np.hstack([q, np.zeros((len(q), 1))]), centres).mean(0)
                near = d.argsort()[:NEAR_PIVOTS]
                yield pd.DataFrame({"qblock": r.qblock, "pivot": near.astype(np.int32), "at": d[near]})

    return blocks.select("qblock", "qs").mapInPandas(run, "qblock long, pivot int, at double")


def _beside(index: Index, meta: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qblock, block): the annuli on both sides of each block of queries, by the order of its nearest pivots."""
    asked = _starts(index, blocks).select("pivot", "at", "qblock", F.lit(None).cast("long").alias("block"))
    rows = meta.select("pivot", F.col("lo").alias("at"), F.lit(None).cast("long").alias("qblock"), "block").unionByName(asked)
    w = Window.partitionBy("pivot").orderBy("at", F.col("qblock").isNotNull())
    before = F.last("block", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("block", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sides = rows.withColumns({"before": before, "after": after}).filter("qblock IS NOT NULL")
    return sides.select("qblock", F.explode(F.array_compact(F.array("before", "after"))).alias("block")).distinct()


def _reaches(index: Index, blocks: DataFrame) -> DataFrame:
    """(qblock, pivot, near, far): for each pivot, least and greatest distance of a block's queries to it.

    near and far are widened by each query's own bound, so one interval test serves the block.
    """
    width, centres = index.width, index.pivots

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q = np.frombuffer(r.qs).reshape(-1, width)
                d = distances(np.hstack([q, np.zeros((len(q), 1))]), centres)
                bound = np.asarray(r.bounds, dtype=float)[:, None]
                # Rounding of the distances must not cut off an annulus.
                room = bound * (1 + 1e-9) + 1e-6 * (1 + d.max())
                yield pd.DataFrame({"qblock": r.qblock, "pivot": np.arange(len(centres), dtype=np.int32), "near": (d - room).min(0), "far": (d + room).max(0)})

    return blocks.mapInPandas(run, "qblock long, pivot int, near double, far double")


def _within(index: Index, meta: DataFrame, bounded: DataFrame) -> DataFrame:
    """(qblock, block): every annulus that meets a block's interval about its pivot.

    A pivot's distances are cut into as many cells as it has annuli. Intervals and annuli meet by cell, each pair in the
    first cell that both have, so what is joined is what is read.
    """
    spans = meta.groupBy("pivot").agg(F.min("lo").alias("base"), F.max("hi").alias("top"), F.count("*").alias("cells"))
    spans = small(index.scratch.table(spans, "spans"), MOST_PIVOTS)
    width = F.greatest((F.col("top") - F.col("base")) / F.col("cells"), F.lit(1e-9))
    cell = lambda x: F.least(F.col("cells") - 1, F.greatest(F.lit(0), F.floor((x - F.col("base")) / width))).cast("long")
    spread = lambda df, a, b, first: df.withColumn(first, cell(F.col(a))).withColumn("cell", F.explode(F.sequence(F.col(first), cell(F.col(b)))))
    reach = _reaches(index, bounded).join(spans, "pivot").filter("far >= base AND near <= top")
    # An unbounded interval is as wide as its pivot's annuli.
    reach = reach.withColumns({"near": F.greatest("near", "base"), "far": F.least("far", "top")})
    asked = spread(reach, "near", "far", "q_first").select("qblock", "pivot", "cell", "near", "far", "q_first")
    there = spread(meta.join(spans, "pivot"), "lo", "hi", "a_first").select("block", "pivot", "cell", "lo", "hi", "a_first")
    met = asked.join(there, ["pivot", "cell"]).filter("cell = greatest(q_first, a_first) AND lo <= far AND hi >= near")
    return met.select("qblock", "block")


def _scored(index: Index, pairs: DataFrame, query_blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each query of the pairs' blocks, the k best that each task meets."""
    width = index.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # k candidates of each query that this task meets
        for pdf in batches:
            for r in pdf.itertuples():
                q, x = np.frombuffer(r.qs).reshape(-1, width), np.frombuffer(r.xs).reshape(-1, width)
                s, all_ids = scores(q, x), np.asarray(r.ids)
                for i, own in enumerate(r.qids):
                    other = np.flatnonzero(all_ids != own)
                    ids, score = all_ids[other], s[i, other]
                    if own in kept:
                        ids, score = np.concatenate([kept[own][0], ids]), np.concatenate([kept[own][1], score])
                    top = best(ids, score, k)
                    kept[own] = ids[top], score[top]
        for own, (ids, score) in kept.items():
            yield pd.DataFrame({"query_id": own, "vec_id": ids, "score": score})

    with_queries = pairs.select("qblock", "block").join(query_blocks.select("qblock", "qids", "qs"), "qblock")
    full = with_queries.join(index.blocks.select("block", "ids", "xs"), "block")
    return full.select("qids", "qs", "ids", "xs").mapInPandas(run, "query_id long, vec_id long, score long")


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query. Partial sums keep k a task, so a query's rows never meet before they are few."""
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).filter(F.col("place") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The k best rows of each of ``queries`` (vec_id, x), the blocks of queries, and the (qblock, block) that were read."""
    scratch = index.scratch
    blocks = _query_blocks(index, queries)
    meta = scratch.table(index.blocks.select("block", "pivot", "lo", "hi", "n"), "meta")
    start = scratch.table(_beside(index, meta, blocks), "start")
    first = scratch.table(_merged(_scored(index, start, blocks, k), k), "first")
    # The k-th score so far bounds the k-th distance; a query with fewer than k is not bounded.
    kth = scratch.table(first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")), "kth")
    asked = blocks.select("qblock", F.posexplode("qids").alias("at", "query_id"))
    known = asked.join(kth, "query_id", "left").groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("at", F.when(F.col("n") >= k, F.col("kth")).alias("kth")))).alias("kths"))
    bounded = _bounded(index, blocks.join(known, "qblock"))
    rest = scratch.table(_within(index, meta, bounded).join(start, ["qblock", "block"], "left_anti"), "rest")
    rows = _scored(index, rest, blocks, k).unionByName(first.select("query_id", "vec_id", "score"))
    return _merged(rows, k), blocks, start.unionByName(rest)


def top_k(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 10, pivots: int | None = None, annulus: int = ANNULUS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, its k highest inner products.

    ``vectors`` has vec_id and embedding; other columns are ignored. All rows but those with the query's own id are
    candidates. Ties go to the smaller vec_id; repeated candidates are listed as often as they occur. Of repeated ids
    that are queries, the least vector asks. Vectors of different length are compared over the shorter one. An empty table
    gives no rows.
    """
    index = Index(integers(vectors), scratch, pivots, annulus)
    if not index.n:
        return scratch.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = index.vectors.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    return search(index, queries, k)[0]


def _bounded(index: Index, blocks: DataFrame) -> DataFrame:
    """``blocks`` with each query's distance bound from its k-th score: |q|^2 + M^2 - 2 score, rooted."""
    width, top = index.width, index.top

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bounds = []
            for r in pdf.itertuples():
                q = np.frombuffer(r.qs).reshape(-1, width)
                kth = np.array([math.nan if x["kth"] is None else float(x["kth"]) for x in r.kths])
                square = (q * q).sum(1) + top * top - 2 * kth
                bounds.append(np.where(np.isnan(square), math.inf, np.sqrt(np.maximum(0.0, square))))
            yield pd.DataFrame({"qblock": pdf.qblock, "qs": pdf.qs, "bounds": bounds})

    return blocks.select("qblock", "qs", "kths").mapInPandas(run, "qblock long, qs binary, bounds array<double>")


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth row of ``embeddings`` against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0, Scratch(spark, "topk"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""
