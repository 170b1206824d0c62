"""The divergence audit against a plain version, and its transducers against sorted lists."""

import collections
import random
import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.llm import divergence
from tablewright.llm.transducer import Transducer, minimal_transducer, packed_transducer
from tablewright.plans.scratch import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def walk(terms, tokens):
    data = np.frombuffer(b"".join(tokens), np.uint8)
    sizes = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(sizes) - sizes
    return Transducer(packed_transducer(minimal_transducer(terms))).ordinals(data, starts, sizes).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_transducer_gives_places(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6))).encode()
    terms = sorted({word() for _ in range(r.choice([1, 30, 700]))})
    tokens = terms + [word() for _ in range(500)] + [b"a" * 300, b""]
    place = {t: i for i, t in enumerate(terms)}
    assert walk(terms, tokens) == [place.get(t, -1) for t in tokens]


def test_transducer_is_minimal():
    # Both stems share all that follows: two levels of stems, then one chain of states for the endings.
    terms = sorted(a + b for a in (b"walk", b"talk", b"balk") for b in (b"", b"ed", b"ing", b"s"))
    parts = minimal_transducer(terms)
    assert len(parts["finals"]) == 1 + len("alk") + 1 + len("e") + len("in") + 1
    assert walk(terms, terms) == list(range(12))
    assert walk([], [b"a", b""]) == [-1, -1]


def plainly(docs, least, top):
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    seen, counts, out = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), []
    for t, lang, s in docs:
        found = TERM.findall(t.translate(LOWER))
        seen[lang].update(set(found))
        counts[lang, s].update(found)
        counts[lang, None].update(found)
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in seen.items()}

    def shares(lang, s):
        total = sum(counts[lang, s][t] for t in kept[lang]) + 5 * len(kept[lang])
        return {t: 1 + 1_000_000_000 * (counts[lang, s][t] + 5) // total for t in kept[lang]}

    groups = sorted({(lang, s) for _, lang, s in docs})
    for lang in kept.keys() | {g[0] for g in groups}:
        kept.setdefault(lang, [])
    p = {g: shares(*g) for g in groups}
    for lang, s in groups:
        q, mine = shares(lang, None), p[lang, s]
        pairs = [(o, sum(abs(mine[t] - p[lang, o][t]) for t in kept[lang])) for x, o in groups if x == lang and o != s]
        terms = [(t, mine[t] - q[t]) for t in kept[lang] if counts[lang, s][t] and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def corpus(spark, n=260):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgé日") for _ in range(r.randint(1, 5))) for _ in range(90)] + ["Über", "É", "é", " x"]
    text = lambda: "".join(r.choice(vocabulary).upper() * r.choice([1, 1, 2]) + r.choice([" ", ", ", "1", "\n", "_"]) for _ in range(r.randint(0, 30)))
    docs = [(text(), r.choice(["en", "en", "en", "de"]), r.choice(["a", "a", "b", "c", "ü"])) for _ in range(n)]
    docs += [(None, "en", "null text"), ("", None, None), ("abc é", None, "x"), ("only here", "fr", "a"), ("", "fr", "b"), (docs[0][0] * 40, "en", "long"), docs[1], docs[1]]
    return docs, spark.createDataFrame(docs, "text string, lang string, source string").withColumn("ordinal", F.lit(1)).withColumn("n", F.lit("clash"))


def test_against_a_plain_version(spark, monkeypatch):
    docs, df = corpus(spark)
    want = plainly(docs, 9, 7)
    assert {w[2] for w in want} == {"pair", "term"}
    out = divergence.source_divergence(df, Scratch(spark, "test"), least_docs=9, top=7)
    assert rows(out) == want
    # Many small transducers, passes, windows, hand-overs and blocks make no difference.
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 16)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)
    parts = divergence.source_divergence(df, Scratch(spark, "test"), least_docs=9, top=7, shard_terms=30, pass_bytes=4_000, window_bytes=50, held=20)
    assert rows(parts) == want


def test_no_terms_and_no_rows(spark):
    docs = [("a b", "en", "x"), ("c", "en", "y"), (None, None, "z")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert rows(divergence.source_divergence(df, Scratch(spark, "test"))) == plainly(docs, 30, 50) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.source_divergence(df.limit(0), Scratch(spark, "test")).collect() == []


def test_shares_are_exact(spark):
    n, total = 90_000_000_000_000_001, 900_000_000_000_000_007
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(3))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 15)
