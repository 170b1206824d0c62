"""The subpackage's queries against their DuckDB twins, and the pipeline against its stages done plainly."""

import collections
import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from verify import bag

import corpus_pipeline
from tablewright.llm.bpe import tokenizer
from tablewright.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_llm import brute_components, brute_targets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    df = QUERIES[key](spark, SF)
    got = df.collect()
    if key in ORACLE_SQL:
        db = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = db.execute(ORACLE_SQL[key])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns) and bag(df.columns, got) == bag(names, cur.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == before
        kept.append(docs.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    quality = [labels[r.doc_id] for r in kept[0] if r.doc_id in labels]
    assert np.mean(quality) > 0.97 and sum(quality) > 0.95 * sum(labels.values())
    wanted = {i for i, _, _, first in brute_components([(r.doc_id, r.text) for r in kept[1]], 5, 80) if first}
    assert {r.doc_id for r in kept[2]} == wanted and len(kept[2]) == len(wanted)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in kept[2]:
        sizes[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    target = brute_targets(dict(sizes))
    assert abs(sum(taken.values()) - sum(target.values())) < 0.2 * sum(target.values())
    final = corpus_pipeline.run(spark, SF).collect()
    bpe = tokenizer()
    texts = {r.doc_id: r.text for r in kept[2]}
    assert collections.Counter(r.doc_id for r in final) == collections.Counter(r.doc_id for r in mixed)
    for r in final:
        ids = bpe.encode(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
