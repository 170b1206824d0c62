"""Fill-in-the-middle against a plain version, with edge cases."""

import hashlib
import re

from conftest import rows
from pyspark.sql import functions as F

from tablewright.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, seed=42, plain_percent=50, spm_percent=80):
    text = text or ""
    name = f"text:{hashlib.md5(text.encode()).hexdigest()}" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - plain_percent:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_a_plain_version(spark):
    texts = ["", None, " ", "  \n", "a", " a", "a ", "a b\tc\n", "é ü x  日本語 <", "one <P> two", "<M>", "<", "<P", "S> <", "\u0085 \x1c x", "word " * 50_000, "\U0001f600 " * 9]
    given = [(i, t) for i, t in enumerate(texts * 8)] + [(None, "no id here"), (None, "nor here at all"), (3, "repeated row"), (3, "repeated row")]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    for options in ({}, {"plain_percent": 0, "seed": 7, "spm_percent": 30, "slice_bytes": 64}, {"plain_percent": 100}):
        out = fill_middle.with_restored(fill_middle.fill_in_middle(docs, **options)).cache()
        options.pop("slice_bytes", None)
        assert rows(out.drop("restored")) == sorted((plainly(*g, **options) for g in given), key=repr)
        assert rows(out.select("doc_id", "restored")) == sorted(((i, t or "") for i, t in given), key=repr)
    assert fill_middle.with_restored(fill_middle.fill_in_middle(docs.limit(0))).collect() == []


def test_slices_hold_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(9))], names=["i"])
    sizes = pa.array([5, 1, 1, 9, 0, 0, 2, 2, 2])
    parts = [p.column(0).to_pylist() for p in fill_middle.slices(batch, sizes, 4)]
    assert parts == [[0], [1, 2], [3], [4, 5, 6, 7], [8]]
    assert list(fill_middle.slices(batch.slice(0, 0), sizes.slice(0, 0), 4)) == []
