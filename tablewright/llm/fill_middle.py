"""Fill-in-the-middle rearrangement of whole texts as a pyarrow.compute pipeline over Arrow batches.

A batch's texts are split into units as one list array. The list is flattened beside its parents' indices, ordinals say where
in its text a unit stands, roles filter the units, and each role's lists are rebuilt from its counts and joined. No step
loops over rows. Texts are handled as bytes: the white space that cuts units is ASCII, and the byte that marks a cut (0xFF)
is in no UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or white space that no word follows.
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
CUT = b"\xff"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = rb"<[PSM]>"
#: Bytes of text whose units are in memory at once; a longer text is handled alone.
SLICE_BYTES = 1 << 22

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_BYTES = pa.large_binary()


def slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``sizes`` sum to ``most`` at most, or of one larger row."""
    first, total = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        if i > first and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if batch.num_rows:
        yield batch.slice(first)


def _starts(counts: pa.Array) -> pa.Array:
    """Offsets of lists of these lengths."""
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts.cast(pa.int64()))])


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def split_units(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(units, n): the units of all texts in a row, and how many each text has."""
    # Each cut stands after its unit, so a list ends with one empty part more than it has units.
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\1" + CUT), CUT)
    n = pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())
    flat = pc.list_flatten(lists)
    return pc.filter(flat, pc.greater(pc.binary_length(flat), 0)), n


def rearranged(batch: pa.RecordBatch, plain_percent: int, spm_percent: int) -> pa.RecordBatch:
    """``SCHEMA`` for a batch (doc_id, text, h1, h2, h3, h4) whose texts are not null."""
    texts = batch.column(1).cast(pa.large_string()).cast(_BYTES)
    h1, h2, h3, h4 = (batch.column(i) for i in range(2, 6))
    units, n = split_units(texts)
    cut_a, cut_b = (_modulo(h, pc.add(n, 1)) for h in (h1, h2))
    low, high = pc.min_element_wise(cut_a, cut_b), pc.max_element_wise(cut_a, cut_b)
    starts = _starts(n)
    lists = pa.LargeListArray.from_arrays(starts, units)
    parents = pc.list_parent_indices(lists)
    places = pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), len(units)))
    ordinals = pc.subtract(places, pc.add(pc.take(starts, parents), 1))
    after_low, after_high = pc.greater_equal(ordinals, pc.take(low, parents)), pc.greater_equal(ordinals, pc.take(high, parents))

    def piece(role: pa.Array, counts: pa.Array) -> pa.Array:
        return pc.binary_join(pa.LargeListArray.from_arrays(_starts(counts), pc.filter(units, role)).cast(pa.list_(_BYTES)), pa.scalar(b"", _BYTES))

    prefix = piece(pc.invert(after_low), low)
    middle = piece(pc.and_not(after_low, after_high), pc.subtract(high, low))
    suffix = piece(after_high, pc.subtract(n, high))
    plain = pc.or_(pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, SENTINEL)), pc.greater_equal(_modulo(h3, 100), 100 - plain_percent))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(_modulo(h4, 100), spm_percent), "spm", "psm"))
    p, s, m, nothing = (pa.scalar(x, _BYTES) for x in (PREFIX, SUFFIX, MIDDLE, b""))
    front = pc.if_else(pc.equal(form, "psm"), pc.binary_join_element_wise(p, prefix, s, suffix, nothing), pc.binary_join_element_wise(s, suffix, p, prefix, nothing))
    output = pc.if_else(plain, texts, pc.binary_join_element_wise(front, m, middle, nothing))
    chars = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column(0), n, form, chars(prefix), chars(middle), output.cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts again. A text with a sentinel of its own is always plain, so a rearranged one splits at its three only."""
    texts = output.cast(pa.large_string()).cast(_BYTES)
    plain = pc.equal(form, "plain")
    # Plain texts stand in as one with three empty pieces.
    parts = pc.split_pattern_regex(pc.if_else(plain, pa.scalar(PREFIX + SUFFIX + MIDDLE, _BYTES), texts), SENTINEL)
    first, second, middle = (pc.list_element(parts, i) for i in (1, 2, 3))
    psm = pc.equal(form, "psm")
    whole = pc.binary_join_element_wise(pc.if_else(psm, first, second), middle, pc.if_else(psm, second, first), pa.scalar(b"", _BYTES))
    return pc.if_else(plain, texts, whole).cast(pa.string())


def draws(doc_id: Column, text: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four 32-bit numbers of a SHA-256 of seed and id; rows without an id are told apart by their text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs`` (doc_id, text; other columns are ignored).

    A map over Arrow batches without a shuffle: rows are independent and draws are hashes, so a rerun gives the same rows.
    ``plain_percent`` of the texts stay as they are, as do empty ones and those that contain a sentinel; of the others
    ``spm_percent`` take the order suffix, prefix, middle. A null text is the empty one. A null id draws by its text.
    Repeated rows each give a row, alike. Very long texts are handled whole, one at a time. An empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(1)), slice_bytes):
                yield rearranged(part, plain_percent, spm_percent)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", *draws(F.col("doc_id"), F.col("text"), seed)).mapInArrow(run, SCHEMA)


def with_restored(rows: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``SCHEMA`` rows with ``restored``, the text rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("output")), slice_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns, restored(part.column("output"), part.column("form"))], names=[*part.schema.names, "restored"])

    return rows.mapInArrow(run, f"{SCHEMA}, restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` rearranged, and rebuilt from what came out."""
    done = with_restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS h FROM documents),
d AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
             WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
