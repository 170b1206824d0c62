"""Every pipeline stage on null ids and texts, empty, blank and long texts, repeated rows, an empty table and clashing columns."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm.bpe import tokenizer
from tests.llm.test_llm import CLASHES, clashing

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
ODD = [(None, None), (None, ""), (None, "no id but words"), (9001, None), (9002, ""), (9003, " \n\t "), (9004, "\U0001f600 é"), (9005, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, odd ones, a very long one, two of them twice, and columns that are named like the operators' own."""
    real = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(i, t, "en" if k % 2 else None, "src0" if k % 3 else None, None) for k, (i, t) in enumerate(ODD)], real.schema)
    long = real.filter("doc_id = 5").withColumns({"doc_id": F.lit(9100).cast("long"), "text": F.repeat(F.concat(F.col("text"), F.lit("\n")), 150)})
    twice = real.filter("doc_id IN (7, 11)")
    rows = real.unionByName(odd).unionByName(long).unionByName(twice).unionByName(odd.filter("doc_id = 9005")).collect()
    return clashing(spark.createDataFrame(rows, real.schema))


def bag(df):
    """Rows by id and text, each with how often it is there; the clashing columns hold their names."""
    rows = df.collect()
    assert all(r[c] == c for r in rows for c in CLASHES)
    return collections.Counter((r.doc_id, r.text) for r in rows)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "byte_bpe"])
def test_columns_and_empty_tables(spark, docs, name):
    out = STAGES[name](spark, docs.limit(0), SF)
    assert out.columns == docs.columns and out.collect() == []


def test_quality_classifier(spark, docs, tmp_path):
    before = bag(docs)
    out = STAGES["quality_classifier"](spark, docs, SF)
    after = bag(out)
    assert out.columns == docs.columns and 0 < len(after) < len(before)
    assert all(before[k] == n for k, n in after.items())  # repeated rows go together
    assert len({(9001, None) in after, (9002, "") in after, (None, None) in after, (None, "") in after}) == 1  # null is the empty text
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert bag(STAGES["quality_classifier"](spark, docs, str(tmp_path))) == before  # nothing to learn from


def test_quality_rules(spark, docs):
    before, out = bag(docs), STAGES["quality_rules"](spark, docs, SF)
    after = bag(out)
    assert out.columns == docs.columns and all(before[k] == n for k, n in after.items())
    assert len(after) > 20 and not {i for i, _ in after} & {None, 9001, 9002, 9003, 9004, 9005}  # fewer than 20 words
    assert 9100 not in {i for i, _ in after}  # 150 times the same


def test_near_dedup(spark, docs):
    before, out = bag(docs), STAGES["minhash_near_dedup"](spark, docs, SF)
    after = bag(out)
    assert out.columns == docs.columns and set(after) <= set(before)
    assert {k: n for k, n in after.items() if k[0] is None} == {k: n for k, n in before.items() if k[0] is None}
    assert all(after[(i, t)] == 1 for i, t in ODD if i is not None)
    assert max(n for k, n in after.items() if k[0] is not None) == 1  # of repeated rows one stays
    assert (9100, next(t for i, t in before if i == 9100)) in after or (5, next(t for i, t in before if i == 5)) in after


def test_mix_sources(spark, docs):
    before, out = bag(docs), STAGES["mix_sources"](spark, docs, SF)
    after = bag(out)
    assert out.columns == docs.columns and set(after) <= set(before)
    taken = {k: n / before[k] for k, n in after.items()}
    assert all(n == int(n) and 1 <= n <= 2 for n in taken.values())  # repeated rows are drawn alike, none beyond the cap
    again = bag(STAGES["mix_sources"](spark, docs.repartition(7), SF))
    assert again == after


def test_byte_bpe(spark, docs):
    out, bpe = STAGES["byte_bpe"](spark, docs, SF).collect(), tokenizer()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter()
    for (i, t), n in bag(docs).items():
        ids = bpe.encode(t or "")
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())] += n
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert STAGES["byte_bpe"](spark, docs.limit(0), SF).collect() == []
