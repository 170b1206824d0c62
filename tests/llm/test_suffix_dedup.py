"""Removal of repeated passages against a plain version."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.llm import suffix_dedup
from tablewright.llm.prefix_free import PLACES, TRIGGER, WINDOW, Block
from tablewright.plans.scratch import Scratch


def plainly(docs):
    """doc_id, n_bytes, spans and kept of (doc_id, text)."""
    place = lambda i: (i is None, i)
    least = {}
    for i, t in docs:
        t = (t or "").encode()
        for at in range(len(t) - 49):
            w = t[at : at + 50]
            if w not in least or place(i) < place(least[w]):
                least[w] = i
    out = []
    for i, t in docs:
        t = (t or "").encode()
        gone = bytearray(len(t) + 1)
        for at in range(len(t) - 49):
            if place(least[t[at : at + 50]]) < place(i):
                gone[at : at + 50] = b"\1" * 50
        spans, start = [], None
        for at, g in enumerate(gone):
            if g and start is None:
                start = at
            elif not g and start is not None:
                spans.append((start, at))
                start = None
        out.append((i, len(t), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def corpus(seed, n=70):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij é") for _ in range(r.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.choice([7, 9, 12, 40])) for _ in range(6)] + ["ab" * 60, "x" * 90, "y" * 50, "z" * 49]
    docs = [(i, text(r.randint(0, 25)) + r.choice(passages) + text(r.randint(0, 9)) + r.choice(passages)[: r.choice([30, 49, 50, 51, 400])]) for i in r.sample(range(-40, 400), n)]
    docs += [(1001, docs[3][1]), (1002, docs[3][1][10:-7]), (1003, docs[5][1] + docs[6][1]), (1004, docs[9][1] * 3), docs[4], (docs[4][0], docs[8][1])]
    return docs + [(500, None), (501, ""), (502, "a" * 49), (503, passages[0]), (None, docs[2][1]), (None, "null id " + text(20)), (None, docs[7][1]), (504, "\0" * 60), (505, "\0" * 70 + "é")]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1500, "bucket_triggers": 40, "many_phrases": 9}, {"block_bytes": 3000, "many_phrases": 0}])
def test_against_a_plain_version(spark, options):
    docs = corpus(len(options))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("kept", F.lit(1)).repartition(5)
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, Scratch(spark, "test"), **options).collect()]
    want = plainly(docs)
    assert sum(len(w[2]) for w in want) > 50
    assert sorted(got, key=repr) == want


def test_no_rows_and_no_table_left(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df, Scratch(spark, "test")).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("text_blocks")]


def test_every_window_has_a_trigger(monkeypatch):
    from tablewright.llm import prefix_free

    r = np.random.default_rng(3)
    texts = [r.integers(97, 97 + k, n).astype(np.uint8) for k, n in ((4, 900), (1, 200), (26, 49), (26, 50), (26, 0), (2, 777))]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = Block(np.concatenate(texts), offsets)
    places, hashes = whole.triggers()
    starts = np.flatnonzero(whole.is_window)
    assert len(starts) == sum(max(0, len(t) - 49) for t in texts)
    assert all(((places >= s) & (places <= s + WINDOW - TRIGGER)).any() for s in starts)
    assert len(places) < len(whole.data) * 2 / PLACES + 200
    kept = whole.phrase_hashes(places), whole.windows(0)
    # Chunks give the same triggers and hashes.
    monkeypatch.setattr(prefix_free, "CHUNK", 64)
    prefix_free._powers.cache_clear()
    assert [a.tolist() for a in whole.triggers()] == [places.tolist(), hashes.tolist()]
    assert whole.phrase_hashes(places).tolist() == kept[0].tolist() and whole.windows(0).tolist() == kept[1].tolist()
    monkeypatch.undo()
    prefix_free._powers.cache_clear()


def test_query_against_a_plain_version(spark, tmp_path):
    import hashlib

    docs = corpus(9)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((i, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in plainly(docs)), key=repr)
    assert rows(suffix_dedup.op11_suffix_array_dedup(spark, str(tmp_path))) == want
