"""Exact removal of repeated passages by prefix-free parsing: suffix arrays of dictionary and parse, over blocks of texts.

1. Whole texts are dealt into blocks and written once, in buckets, so that no later step moves them.
2. Rolling-hash triggers cut each block into overlapping phrases (``prefix_free``); every window of 50 bytes lies whole within
   one. A block sends each trigger's hash once; hashes that a single document has are done with, as no window around
   them can repeat.
3. Phrases of the other triggers are the dictionary. A block sends each once, with the least of its documents that has it. All
   phrases of a trigger meet in one bucket, where suffix arrays of the dictionary give equal windows one number, and the
   parse's order, by document, tells which of a number's phrases come first.
4. Blocks are told which windows of their phrases a smaller document has; what those cover is removed.

What passes between blocks and buckets is packed: a row holds all that one has for the other. A trigger with a great many
distinct phrases, such as a short passage in every other document, sends windows instead, each once a block, so that the
rows that meet in a task grow with the blocks and not with the documents.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.prefix_free import AFTER, BEFORE, PLACES, WINDOW, Block, distinct, repeated_places
from tablewright.plans.scratch import Scratch, delete_path

#: Bytes of text of a block, and triggers of a bucket, on average. Tens of terabytes want both larger, by the same factor.
BLOCK_BYTES, BUCKET_TRIGGERS = 1 << 22, 1 << 19
#: Distinct phrases of a trigger beyond which its windows are sent.
MANY_PHRASES = 1 << 14
#: Buckets that Spark lets a table have.
MOST_FILES = 100_000

SENT = "bucket long, block long, hashes binary, codes binary"
TOLD = "block long, hashes binary, many binary"
PARTS = "bucket long, block long, phrase_hashes binary, phrases binary, reach binary, phrase_docs binary, window_a binary, window_b binary, window_docs binary"
FOUND = "block long, phrase_hashes binary, places binary, windows binary, window_docs binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` of a hash: its bucket."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _joined(blobs: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal ``keys``."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(keys))


def _block_of(table: pa.Table) -> tuple[Block, np.ndarray, pa.ChunkedArray]:
    """The texts of a block, each row's rank in the order of documents (nulls last), and the ids."""
    ids, texts = table.column("doc_id"), table.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    order = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    return Block(data, offsets - offsets[0]), order, ids


def _send_triggers(bits: int):
    """Each trigger's hash once a block; its code holds the number of distinct phrases and whether several documents have it."""

    def run(table: pa.Table) -> pa.Table:
        block, order, _ = _block_of(table)
        places, hashes = block.triggers()
        docs = order[block.text_of[places]]
        first, inverse, _, several = distinct(hashes, docs)
        phrase_first = distinct(block.phrase_hashes(places), docs)[0]
        codes = np.minimum(np.bincount(inverse[phrase_first], minlength=len(first)), 0x7FFF).astype(np.uint16) * np.uint16(2) + several
        keys = hashes[first]
        starts, ends = _runs(_top(keys, bits))
        rest = (keys >> np.uint64(32 - bits)).astype(np.uint32)
        rows = [(int(b), table["block"][0].as_py(), rest[s:e].tobytes(), codes[s:e].astype(np.uint16).tobytes()) for b, s, e in zip(_top(keys[starts], bits), starts, ends)]
        return pa.Table.from_pylist([dict(zip(("bucket", "block", "hashes", "codes"), r)) for r in rows], pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("codes", pa.binary())]))

    return run


def _tell_repeated(many: int):
    """To each block those of its hashes that more than one document has, and whether they have ``many`` phrases."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.hashes.map(len).to_numpy() // 4
        sender = np.repeat(np.arange(len(pdf)), sizes)
        hashes, codes = _joined(pdf.hashes, np.uint32), _joined(pdf.codes, np.uint16)
        order = np.argsort(hashes, kind="stable")
        starts, ends = _runs(hashes[order])
        phrases = np.add.reduceat((codes >> 1)[order].astype(np.int64), starts)
        several = np.maximum.reduceat((codes & 1)[order], starts) > 0
        repeated, heavy = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.uint8)
        repeated[order] = np.repeat(several | (ends - starts > 1), ends - starts)
        heavy[order] = np.repeat(phrases > many, ends - starts)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        keep = [np.flatnonzero(repeated[a:b]) + a for a, b in zip(bounds[:-1], bounds[1:])]
        prefix = np.uint64(int(pdf.bucket.iloc[0])) << np.uint64(32)
        rows = [(block, (prefix | hashes[k].astype(np.uint64)).tobytes(), heavy[k].tobytes()) for block, k in zip(pdf.block, keep) if len(k)]
        return pd.DataFrame(rows, columns=["block", "hashes", "many"])

    return run


def _send_phrases(bits: int):
    """The dictionary of a block, a row for each bucket: phrases of repeated triggers and windows of those with many phrases."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        block, order, _ = _block_of(table)
        places, hashes = block.triggers()
        known, heavy = (_joined(told.column(c).to_pylist(), k) for c, k in (("hashes", np.uint64), ("many", np.uint8)))
        by_hash = np.argsort(known, kind="stable")
        known, heavy = known[by_hash], heavy[by_hash]
        keys = hashes >> np.uint64(32 - bits)
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        repeated = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        is_heavy = repeated & (heavy[at] > 0) if len(known) else repeated
        rows: dict[int, dict] = {}
        row = lambda b: rows.setdefault(int(b), {"bucket": int(b), "block": table["block"][0].as_py()} | dict.fromkeys(names[2:], b""))
        names = [f.split()[0] for f in PARTS.split(", ")]
        light = np.flatnonzero(repeated & ~is_heavy)
        if len(light):
            ids = block.phrase_hashes(places[light])
            first, _, least, _ = distinct(ids, order[block.text_of[places[light]]])
            by_bucket = np.argsort(hashes[light[first]], kind="stable")
            chosen, least = light[first][by_bucket], least[by_bucket]
            ids, phrases, reach = ids[first][by_bucket], block.phrases(places[chosen]), np.stack(block.reach(places[chosen]), axis=1).astype(np.uint8)
            buckets = _top(hashes[chosen], bits)
            for s, e in zip(*_runs(buckets)):
                row(buckets[s]).update(phrase_hashes=ids[s:e].tobytes(), phrases=phrases[s:e].tobytes(), reach=reach[s:e].tobytes(), phrase_docs=least[s:e].tobytes())
        if is_heavy.any():
            before, after = block.reach(places[is_heavy])
            starts = np.concatenate([(places[is_heavy] - y)[(before >= y) & (after >= WINDOW - y)] for y in range(PLACES)])
            starts = np.unique(starts)
            a, b = block.windows(0)[starts], block.windows(1)[starts]
            first, _, least, _ = distinct(a, order[block.text_of[starts]])
            buckets = _top(a[first], bits)
            for s, e in zip(*_runs(buckets)):
                row(buckets[s]).update(window_a=a[first][s:e].tobytes(), window_b=b[first][s:e].tobytes(), window_docs=least[s:e].tobytes())
        kinds = [pa.int64()] * 2 + [pa.binary()] * 7
        return pa.Table.from_pylist(list(rows.values()), pa.schema(list(zip(names, kinds))))

    return run


def _find_repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each block the windows of its phrases that a smaller document has, and the least documents of its windows."""
    sizes = pdf.phrase_hashes.map(len).to_numpy() // 8
    ids, docs = _joined(pdf.phrase_hashes, np.uint64), _joined(pdf.phrase_docs, np.int64)
    reach = _joined(pdf.reach, np.uint8).reshape(-1, 2).astype(np.int64)
    phrases = _joined(pdf.phrases, np.uint8).reshape(-1, BEFORE + AFTER)
    places = repeated_places(phrases, reach[:, 0], reach[:, 1], docs) if len(ids) > 1 else np.zeros(len(ids), np.uint32)
    windows = pdf.window_a.map(len).to_numpy() // 8
    a, b, seen = _joined(pdf.window_a, np.uint64), _joined(pdf.window_b, np.uint64), _joined(pdf.window_docs, np.int64)
    order = np.lexsort((b, a))
    starts, ends = _runs(np.stack([a, b], axis=1)[order].view("u8,u8").ravel() if len(a) else a)
    least = np.empty(len(a), np.int64)
    if len(a):
        least[order] = np.repeat(np.minimum.reduceat(seen[order], starts), ends - starts)
    rows, p, w = [], 0, 0
    for block, n, m in zip(pdf.block, sizes, windows):
        hit = p + np.flatnonzero(places[p : p + n])
        rows.append((block, ids[hit].tobytes(), places[hit].tobytes(), a[w : w + m].tobytes(), least[w : w + m].tobytes()))
        p, w = p + n, w + m
    return pd.DataFrame([r for r in rows if r[1] or r[3]], columns=["block", "phrase_hashes", "places", "windows", "window_docs"])


def _remove(table: pa.Table, found: pa.Table) -> pa.Table:
    """The texts of a block without what smaller documents have."""
    block, order, ids = _block_of(table)
    told = [_joined(found.column(c).to_pylist(), k) for c, k in (("phrase_hashes", np.uint64), ("places", np.uint32), ("windows", np.uint64), ("window_docs", np.int64))]
    known, masks, windows, least = told
    repeated = np.zeros(len(block.data), bool)
    places, _ = block.triggers()
    if len(places):
        docs, keys = order[block.text_of[places]], block.phrase_hashes(places)
        _, inverse, first_doc, _ = distinct(keys, docs)
        # Of a phrase that a smaller document of this block has, every window; of others, what the block was told.
        sets = np.where(docs > first_doc[inverse], np.uint32((1 << PLACES) - 1), np.uint32(0))
        if len(known):
            by_key = np.argsort(known, kind="stable")
            known, masks = known[by_key], masks[by_key]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            sets = np.where(known[at] == keys, sets | masks[at], sets)
        before, after = block.reach(places)
        for y in range(PLACES):
            hit = ((sets >> np.uint32(y)) & 1 > 0) & (before >= y) & (after >= WINDOW - y)
            repeated[places[hit] - y] = True
    if len(windows):
        by_key = np.argsort(windows, kind="stable")
        windows, least = windows[by_key], least[by_key]
        keys = block.windows(0)
        at = np.minimum(np.searchsorted(windows, keys), len(windows) - 1)
        repeated |= (windows[at] == keys) & (least[at] < order[block.text_of])
    change = np.zeros(len(repeated) + WINDOW, np.int8)
    change[:-WINDOW] += repeated
    change[WINDOW:] -= repeated
    gone = np.cumsum(change, out=change)[: len(repeated)] > 0
    begins, ends = gone & (np.concatenate([[False], gone])[:-1] == 0), gone & (np.concatenate([gone, [False]])[1:] == 0)
    # Runs end with their text.
    begins |= gone & (block.behind == 0)
    ends |= gone & (block.ahead == 1)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = block.text_of[start]
    kept = np.concatenate([np.zeros(1, np.int32), np.cumsum(~gone, dtype=np.int32)])[block.offsets]
    spans = pa.StructArray.from_arrays([pa.array(start - block.offsets[text]), pa.array(end - block.offsets[text])], names=["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, block.offsets).astype(np.int32)), spans)
    data = pa.Array.from_buffers(pa.binary(), len(kept) - 1, [None, pa.py_buffer(kept), pa.py_buffer(block.data[~gone])])
    return pa.table({"doc_id": ids, "n_bytes": pa.array(np.diff(block.offsets)), "spans": lists, "kept": data})


def _write_blocks(docs: DataFrame, blocks: int, name: str, path: str) -> None:
    """A table (block, doc_id, text) in buckets of blocks, which grouping by block reads in place."""
    files = min(blocks, MOST_FILES)
    # Rows without an id are dealt by their text.
    dealt = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)).cast("long")
    rows = docs.select(dealt.alias("block"), "doc_id", "text").repartition(files, "block")
    rows.write.bucketBy(files, "block").option("path", path).option("compression", "zstd").saveAsTable(name)


def remove_repeats(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, bucket_triggers: int = BUCKET_TRIGGERS, many_phrases: int = MANY_PHRASES) -> DataFrame:
    """doc_id, n_bytes, spans (removed, start and end) and kept (the remaining bytes) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Removed is each byte of a string of 50 bytes that also starts in a document with a smaller doc_id. Strings never cross
    documents. A null text is the empty one and loses nothing, as does any text below 50 bytes. Rows with one doc_id, and
    rows without one, take nothing from each other; those without come after all others. Very long texts are handled whole,
    in a block of their own size. An empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / 15 / bucket_triggers))))
    name, path = f"text_blocks_{uuid.uuid4().hex}", scratch.path("blocks")
    _write_blocks(docs, max(1, math.ceil(total / block_bytes)), name, path)
    try:
        texts = spark.table(name).groupBy("block")
        sent = texts.applyInArrow(_send_triggers(bits), SENT)
        told = scratch.table(sent.groupBy("bucket").applyInPandas(_tell_repeated(many_phrases), TOLD), "told")
        parts = texts.cogroup(told.groupBy("block")).applyInArrow(_send_phrases(bits), PARTS)
        found = scratch.table(parts.groupBy("bucket").applyInPandas(_find_repeated, FOUND), "found")
        kept = scratch.table(texts.cogroup(found.groupBy("block")).applyInArrow(_remove, RESULT), "kept")
        scratch.drop(told, found)
        return kept
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(spark, path)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` without what a document of a smaller id has."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "repeats"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
