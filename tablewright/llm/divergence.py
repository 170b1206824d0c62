"""Source divergence audit over a vocabulary held as minimal acyclic transducers.

Terms that enough documents of a language have are kept, numbered in the order of their bytes and built into transducers of
bounded size, each over a run of ordinals. All texts are then streamed through the transducers, which counts kept terms by
their ordinals and lets everything else fall out at the first byte that no term has. From there on a term is its ordinal, in
joins and in breaking ties; its text is looked up for the rows returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.near_dedup import LOWER, UPPER
from tablewright.llm.transducer import Transducer, minimal_transducer, packed_transducer
from tablewright.operators.windows import counts_before
from tablewright.plans.scratch import Scratch

#: Bytes between terms: all ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of one transducer, which one task builds.
SHARD_TERMS = 1 << 16
#: Bytes of packed transducers that are broadcast for one pass over the texts; a larger vocabulary takes more passes.
PASS_BYTES = 1 << 25
#: Bytes of text whose tokens are in memory at once, cut between tokens.
WINDOW_BYTES = 1 << 21
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 1 << 19
#: Terms and sources of a block that one task compares.
BLOCK_TERMS, BLOCK_SOURCES = 1024, 256
#: Fixed values of the measure.
ONE, PRIOR = 1_000_000_000, 5

_IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_LOWERED = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_ORDINAL_BITS = 40


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, with A-Z (and no other letter) in lower case."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_distinct(F.filter(F.split(lowered, BETWEEN), lambda t: t != ""))


def kept_terms(docs: DataFrame, least_docs: int, scratch: Scratch) -> DataFrame:
    """(lang, term, ordinal): terms of at least ``least_docs`` rows of a language, numbered from 0 by their bytes."""
    seen = docs.select("lang", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("docs"))
    kept = scratch.table(seen.filter(F.col("docs") >= least_docs).select("lang", "term"), "kept")
    return scratch.table(counts_before(kept, ["lang"], "term", scratch).select("lang", "term", F.col("before").cast("long").alias("ordinal")), "terms")


def transducers(terms: DataFrame, scratch: Scratch, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, base, first, last, bytes, blob): the vocabulary in transducers of ``shard_terms`` ordinals each.

    ``first`` and ``last`` are the numbers of the first four bytes of a transducer's least and greatest term.
    """

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        terms = [t.encode() for t in pdf.term]
        blob = packed_transducer(minimal_transducer(terms))
        number = lambda t: int.from_bytes(t[:4].ljust(4, b"\0"), "big")
        return pd.DataFrame([(key[0], int(pdf.ordinal.iloc[0]), number(terms[0]), number(terms[-1]), len(blob), blob)], columns=["lang", "base", "first", "last", "bytes", "blob"])

    shards = terms.groupBy("lang", F.floor(F.col("ordinal") / shard_terms).alias("shard"))
    return scratch.table(shards.applyInPandas(build, "lang string, base long, first long, last long, bytes long, blob binary"), "transducers")


class Counter:
    """Counts of (language, source, ordinal) of one task, by the transducers of one pass."""

    def __init__(self, shards: list[tuple[str, int, int, int, bytes]]):
        self.shards: dict[str, list] = {}
        for lang, base, first, last, blob in shards:
            self.shards.setdefault(lang, []).append((base, first, last, Transducer(blob)))
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch, window_bytes: int) -> None:
        """Streams a batch (lang, source, text) without nulls through its languages' transducers."""
        text = batch.column(2)
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        if not len(text) or offsets[0] == offsets[-1]:
            return
        data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        langs = batch.column(0).to_pylist()
        groups = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, batch.column(1).to_pylist())], np.int64)
        codes = {lang: i for i, lang in enumerate(self.shards)}
        lang_of = np.array([codes.get(lang, -1) for lang in langs])
        inside = _IN_TERM[data]
        # Whether a term goes on from the byte before: not over the border of two texts.
        goes_on = np.zeros(len(data) + 1, bool)
        goes_on[1:-1] = inside[1:] & inside[:-1]
        goes_on[offsets] = False
        at = 0
        while at < len(data):
            end = min(at + window_bytes, len(data))
            cuts = np.flatnonzero(~goes_on[at + 1 : end + 1])
            end = at + 1 + int(cuts[-1]) if len(cuts) else end + int(np.argmin(goes_on[end:]))
            here = inside[at:end]
            starts = at + np.flatnonzero(here & ~goes_on[at:end])
            sizes = at + np.flatnonzero(here & ~goes_on[at + 1 : end + 1]) + 1 - starts
            self._count(_LOWERED[data[at:end]], starts - at, sizes, np.searchsorted(offsets, starts, "right") - 1, groups, lang_of)
            at = end

    def _count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, groups: np.ndarray, lang_of: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        number = np.zeros(len(starts), np.int64)
        for i in range(4):
            number = number * 256 + np.where(sizes > i, padded[starts + i], 0)
        for code, shards in enumerate(self.shards.values()):
            of_lang = np.flatnonzero(lang_of[rows] == code)
            for base, first, last, transducer in shards:
                mine = of_lang[(number[of_lang] >= first) & (number[of_lang] <= last)]
                place = transducer.ordinals(data, starts[mine], sizes[mine])
                met = place >= 0
                if met.any():
                    self.held.append(np.unique((groups[rows[mine[met]]] << _ORDINAL_BITS) | (base + place[met]), return_counts=True))

    def counted(self, most: int) -> Iterator[pa.RecordBatch]:
        """The counts, once they are more than ``most``."""
        if sum(len(k) for k, _ in self.held) <= most:
            return
        keys, inverse = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([n for _, n in self.held]), len(keys)).astype(np.int64)
        if 2 * len(keys) <= most:
            self.held = [(keys, counts)]
            return
        names, group = list(self.groups), pa.array(keys >> _ORDINAL_BITS)
        columns = [pc.take(pa.array([n[i] for n in names], pa.string()), group) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(keys & ((1 << _ORDINAL_BITS) - 1)), pa.array(counts)], names=["lang", "source", "ordinal", "n"])
        self.held, self.groups = [], {}


def counted_through(docs: DataFrame, shards: Broadcast, window_bytes: int = WINDOW_BYTES, held: int = HELD_COUNTS) -> DataFrame:
    """(lang, source, ordinal, n), in parts that add up: one pass of all texts through broadcast transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shards.value)
        for batch in batches:
            counter.add(batch, window_bytes)
            yield from counter.counted(held)
        yield from counter.counted(0)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal long, n long")


def term_counts(docs: DataFrame, built: DataFrame, scratch: Scratch, pass_bytes: int = PASS_BYTES, **options) -> DataFrame:
    """(lang, source, ordinal, n) of all kept terms that a source has, in as many passes as the transducers need."""
    spark, parts = docs.sparkSession, []
    # A row a transducer, in the order of the passes.
    shapes = built.select("lang", "base", "bytes").orderBy("lang", "base").collect()
    passes: list[list] = []
    room = 0
    for s in shapes:
        if not passes or s["bytes"] > room:
            passes.append([])
            room = pass_bytes
        passes[-1].append(s)
        room -= s["bytes"]
    for i, members in enumerate(passes):
        wanted = spark.createDataFrame([(s["lang"], s["base"]) for s in members], "lang string, base long")
        shards = spark.sparkContext.broadcast([tuple(r) for r in built.join(F.broadcast(wanted), ["lang", "base"]).select("lang", "base", "first", "last", "blob").collect()])
        summed = counted_through(docs, shards, **options).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        parts.append(scratch.table(summed, f"counts{i}"))
        shards.unpersist()
    if not parts:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + PRIOR) / (total + PRIOR * terms)), in whole numbers throughout."""
    exact = lambda c: c.cast("decimal(20,0)")
    above = F.lit(ONE).cast("decimal(10,0)") * exact(n + F.lit(PRIOR))
    below = exact(total) + exact(terms) * F.lit(PRIOR).cast("decimal(2,0)")
    return F.call_function("div", above, below) + F.lit(1)


def _pair_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences over one block of terms, between the left and the right sources of one block pair."""

    def dense(rows: pd.DataFrame) -> np.ndarray:
        out = np.repeat(rows.nothing.to_numpy(np.int64)[:, None], int(pdf.width.iloc[0]), axis=1)
        for i, (places, values) in enumerate(zip(rows.places, rows.shares)):
            out[i, np.asarray(places, np.int64)] = values
        return out

    left, right = pdf[pdf.is_left], pdf[~pdf.is_left]
    a, b = dense(left), dense(right)
    names = right.source.to_numpy()
    found = [pd.DataFrame({"lang": key[0], "source": s, "item": names, "value": np.abs(row - b).sum(axis=1)}) for s, row in zip(left.source, a)]
    return pd.concat([f[f.source != f.item] for f in found]) if found else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})


def pair_distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources.

    ``groups`` has lang, source, terms (of the language) and nothing (the share of a term that the source lacks); ``shares``
    has lang, source, ordinal and p. Terms and sources are compared in blocks, whose sums are added up.
    """
    block, place = F.floor(F.col("ordinal") / BLOCK_TERMS).alias("block"), (F.col("ordinal") % BLOCK_TERMS).cast("int")
    sparse = shares.groupBy("lang", "source", block).agg(F.collect_list(F.struct(place.alias("place"), "p")).alias("had"))
    last_block = F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / BLOCK_TERMS)
    dealt = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    rows = dealt.join(sparse, ["lang", "source", "block"], "left").withColumn("width", F.least(F.lit(BLOCK_TERMS).cast("long"), F.col("terms") - F.col("block") * BLOCK_TERMS))
    many = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).alias("parts"))
    rows = rows.join(many, "lang").withColumn("part", F.pmod(F.xxhash64("source"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    had = lambda field: F.coalesce(F.col("had").getField(field), F.array().cast(f"array<{'int' if field == 'place' else 'bigint'}>"))
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("is_left")
    sides = rows.select("lang", "source", "block", "width", F.coalesce("nothing", F.lit(0)).alias("nothing"), had("place").alias("places"), had("p").alias("shares"), "part", "other", both)
    sides = sides.withColumn("i", F.when(F.col("is_left"), F.col("part")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("is_left"), F.col("other")).otherwise(F.col("part")))
    sums = sides.groupBy("lang", "block", "i", "j").applyInPandas(_pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, scratch: Scratch, least_docs: int = 30, top: int = 50, shard_terms: int = SHARD_TERMS, pass_bytes: int = PASS_BYTES, **options) -> DataFrame:
    """lang, source, part, item, value and rank for ``docs`` (text, lang, source; other columns are ignored).

    Part ``pair`` ranks the other sources of a language by distance; part ``term`` the ``top`` terms that a source has more
    of than its language. Null text, lang and source are read as ''. Repeated rows each count as a document. Texts are
    counted whole, however long, in windows cut between terms. A group without terms takes part with counts of 0; a
    language without kept terms has distances of 0. Equal values are ranked by the bytes of their item. An empty table gives
    none.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    terms = kept_terms(docs, least_docs, scratch)
    counts = scratch.table(term_counts(docs, transducers(terms, scratch, shard_terms), scratch, pass_bytes, **options), "counts")
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"))
    nothing = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
    groups = scratch.table(groups.withColumn("nothing", nothing), "groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "ordinal", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    shares = scratch.table(shares, "shares")
    by_value = lambda tie: Window.partitionBy("lang", "source").orderBy(F.desc("value"), tie)
    pairs = pair_distances(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value("item")).alias("rank"))
    whole = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.sum("total").alias("total"))
    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "ordinal", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    above = shares.join(of_lang, ["lang", "ordinal"]).select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value")).filter("value > 0")
    best = above.withColumn("rank", F.row_number().over(by_value("ordinal"))).filter(F.col("rank") <= top)
    named = best.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(named)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language of ``documents``, and the terms that set each apart."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "divergence"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
x AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term FROM x GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN v USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p FROM n WINDOW s AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS q FROM l WINDOW s AS (PARTITION BY lang)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
