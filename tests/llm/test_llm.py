"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import base64
import collections
import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.llm import bpe, graph, labelled, mixing, near_dedup, quality_classifier, quality_rules, tool_calls, topk_search, toxicity, url_lists, warc
from tablewright.plans.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, value string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, texts, lang="en", source="s"):
    """Documents with an extra column."""
    return spark.createDataFrame([(i, t, lang, source, None, "v") for i, t in texts], DOCS)


#: Names that operators use inside or give to their outputs.
CLASHES = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "distance", "quality_ok", "grp", "lang_grp", "d2", "x1", "m1", "l11", "z1", "scored", "tail", "expected_grade", "quality_kept", "toxicity", "toxic_spans", "crf", "mix_size", "mix_source", "mix_source_size", "mix_target", "mix_copies", "mix_copy", "source_size", "target", "size", "draw", "text_md5", "class", "node", "n", "component", "kept", "value.dotted"]


def clashing(df):
    """``df`` with a column of each of these names, which holds the name."""
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES])


def unclashed(df, before):
    """Checks that the clashing columns came through; returns the outputs, named without their underscores."""
    assert df.columns[: len(before)] == before
    got = df.select(*[F.col(f"`{c}`") for c in CLASHES]).distinct().collect()
    assert [tuple(r) for r in got] in ([], [tuple(CLASHES)])
    return df.select("doc_id", *[F.col(c).alias(c.rstrip("_")) for c in df.columns[len(before) :]])


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


# WARC


def test_warc(spark, scratch):
    pages = [(3, "http://a/ x", "hello"), (1, "http://b", "hello"), (2, None, None), (5, "u", ""), (4, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\né"), (6, "u", "x" * 200_000), (6, "u", "x" * 200_000), (None, "u", "hello"), (None, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    path = scratch.path("archive")
    assert warc.write_deduplicated(df, path, scratch, archive_bytes=16) == len(pages)
    read = warc.read_archives(spark, path, with_payload=True)
    assert warc.all_sound(read, len(pages)).select("record_id").distinct().count() == len(pages)
    with pytest.raises(ValueError, match="records were written"):
        warc.all_sound(read, len(pages) + 1)
    assert all(r.digest_ok for r in read.filter("record_type = 'response'").collect())
    assert {bytes(r.payload).decode() for r in read.filter("page_id IN (1, 4)").collect()} == {"hello", pages[4][2]}
    out = warc.resolve_revisits(read, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {1: None, 2: None, 3: 1, 5: 2, 4: None, 6: None}
    want = [(i, len((h or "").encode()), sha(h), "response" if first.get(i, 1 if h == "hello" else None) is None else "revisit", first.get(i, 1 if h == "hello" else None)) for i, _, h in pages]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_warc_small_payloads_and_none(spark, scratch):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    for source, want in ((df, [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]), (df.limit(0), [])):
        path = scratch.path("archive")
        warc.write_deduplicated(source, path, scratch, min_bytes=3)
        assert rows(warc.read_archives(spark, path).select("page_id", "record_type")) == want


def test_warc_archives_are_bounded(spark, scratch):
    r = random.Random(8)
    sizes = [r.choice([0, 1, 5, 60, 900, 5000]) for _ in range(300)] + [70_000]
    df = spark.createDataFrame([(i, "u", "".join(r.choices("abc", k=n))) for i, n in enumerate(sizes)], "page_id long, url string, html string").repartition(3)
    path = scratch.path("archive")
    warc.write_deduplicated(df, path, scratch, archive_bytes=8_192)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).collect()
    held = [[len(block.partition(b"\r\n\r\n")[2]) for _, block in warc.parse_records(warc.inflate(bytes(f.content)))] for f in files]
    assert sum(map(len, held)) == len(sizes) and all(sum(h) <= 8_192 or len(h) == 1 for h in held) and len(held) < 200


def test_warc_headers_and_cut_off_records(spark, scratch):
    df = spark.createDataFrame([(2, "http://b/", "same"), (1, "http://a/", "same")], "page_id long, url string, html string").coalesce(1)
    path = scratch.path("archive")
    warc.write_deduplicated(df, path, scratch, date="2024-05-06T07:08:09Z")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).collect()
    data = b"".join(warc.inflate(bytes(f.content)) for f in files)
    heads = {h["x-page-id"]: h for h, _ in warc.parse_records(data)}
    assert heads["2"]["warc-refers-to"] == heads["1"]["warc-record-id"] and heads["2"]["warc-refers-to-target-uri"] == "http://a/"
    assert heads["2"]["warc-refers-to-date"] == heads["1"]["warc-date"] == "2024-05-06T07:08:09Z"
    for cut in (len(data) - 8, len(data) // 2, 20):
        with pytest.raises(ValueError):
            list(warc.parse_records(data[:cut]))


# Near duplicates


def brute_components(docs, width, percent):
    table = str.maketrans(near_dedup.UPPER, near_dedup.LOWER)
    sets = []
    for i, t in docs:
        w = SPLIT.findall((t or "").translate(table))
        sets.append((i, {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least[top(k)], i == least[top(k)]) for k, (i, s) in enumerate(sets)), key=repr)


def near_corpus():
    """Groups of near copies with any number of edits, chains that drift, one passage in many texts, short texts."""
    r, out = random.Random(5), []
    for g, (size, length, most) in enumerate([(40, 120, 22), (25, 60, 12), (12, 300, 60), (20, 15, 3)]):
        base = words(length, g)
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, most)):
                w[r.randrange(len(w))] = r.choice("xyz") + str(r.randrange(10**6))
            out.append(" ".join(w))
    drift = words(100, 77)
    for k in range(20):
        drift[(k * 7) % 100] = f"new{k}"
        out.append(" ".join(drift))
    passage = " ".join(words(50, 99))
    out += [f"{' '.join(words(30, 1000 + k))} {passage} {' '.join(words(30, 2000 + k))}" for k in range(30)]
    out += ["", None, "   \n", "one", "One", "ONE two", "one  TWO", "É b c", "é b c", "a a a a a a", "a a", out[0], out[0].upper()]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates(spark, scratch, width, percent):
    docs = near_corpus()
    got = near_dedup.near_duplicates(corpus(spark, docs), scratch, width, percent)
    assert rows(got) == brute_components(docs, width, percent)


def test_near_duplicates_in_many_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    docs = near_corpus()
    assert rows(near_dedup.near_duplicates(corpus(spark, docs), scratch, 2, 80, k=16)) == brute_components(docs, 2, 80)


def test_near_duplicates_of_repeated_rows(spark, scratch):
    docs = near_corpus()[::2]
    got = rows(near_dedup.near_duplicates(corpus(spark, docs * 3), scratch, 2, 80))
    assert got == sorted(brute_components(docs, 2, 80) * 3, key=repr)


def test_lists_hold_no_texts_that_share_shingles_by_chance(spark, scratch):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(200)}" for _ in range(200)) for _ in range(300)]
    near = texts[7].replace("w1 ", "edited ")
    sets = near_dedup.shingle_set(near_dedup.words_of(F.col("text")), 2)
    nodes = corpus(spark, list(enumerate([*texts, near]))).select(F.col("doc_id").alias("node"), sets.alias("all")).select("node", F.size("all").alias("n"), F.slice("all", 1, 64).alias("sketch"))
    posted = near_dedup.list_hubs(near_dedup.prefix_postings(scratch.table(nodes, "nodes"), 0.8, scratch), scratch)
    strange = posted.filter("NOT (hub IN (7, 300) AND node IN (7, 300))").count()
    assert strange < 150 and posted.filter("hub + node = 307").count() > 0


@pytest.mark.parametrize("k", [16, 64])
def test_linked_sets_share_the_neighbours_needed(spark, k):
    r, pairs = random.Random(k), []
    for n in [*range(1, 90)] * 12 + [r.randint(90, 400) for _ in range(400)]:
        # A sketch of 16 is held to the certain bound only.
        a = [r.randrange(-(1 << 63), 1 << 63) for _ in range(n)] if k == 64 or n <= 16 else []
        b = a[r.randint(0, n // 5) :] + [r.randrange(-(1 << 63), 1 << 63) for _ in range(r.randint(0, n // 4))]
        if a and 10 * len({*a} & {*b}) >= 8 * len({*a} | {*b}):
            pairs.append((sorted(a), sorted(b)))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>").select("a", "b", F.size("a").alias("n_a"), F.size("b").alias("n_b"))
    of = lambda s: near_dedup.neighbours(F.slice(s, 1, k), F.col(f"n_{s}"), k)
    need = F.greatest(*[F.when((F.col(f"n_{s}") <= k) | (F.lit(k) == 64), near_dedup.needed_overlap(F.col(f"n_{s}"), 0.8, k)).otherwise(0) for s in "ab"])
    assert len(pairs) > 50 and df.filter(F.size(F.array_intersect(of("a"), of("b"))) < need).count() == 0


def test_near_duplicates_edges(spark, scratch):
    assert rows(near_dedup.near_duplicates(corpus(spark, []), scratch)) == []
    repeated = corpus(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z")])
    assert rows(near_dedup.near_duplicates(repeated, scratch, 2)) == sorted([(1, 5, 1, True), (1, 5, 1, True), (None, 5, 1, False), (None, 1, None, True)], key=repr)


def test_components_of_chains_and_loops(spark, scratch):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)] + [(300, x) for x in range(301, 340)]
    out = dict(rows(graph.connected_components(spark.createDataFrame(edges, "a long, b long"), scratch)))
    assert all(out[i] == 0 for i in range(31)) and out[101] == 100 and out[339] == 300 and 200 not in out
    assert rows(graph.connected_components(spark.createDataFrame([], "a long, b long"), scratch)) == []


# Top-k


def brute_top_k(vectors, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % 100 == 0:
            s = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q))[:k]
            out += [(q, r, i, -v) for r, (v, i) in enumerate(s, 1)]
    return sorted(out, key=repr)


def test_top_k(spark, scratch):
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 8))
    v = [(i, [float(np.float32(x)) for x in centres[i % 5] * r.uniform(0.1, 3) + 0.1 * r.normal(size=8)]) for i in range(600)]
    v += [(i, v[3][1]) for i in range(600, 700)] + [(700, None), (701, [float("nan")] * 8), (702, [None] * 8), (800, [0.0] * 8), (None, v[0][1]), (900, [1.0, 2.0]), (901, [])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash"))
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, scratch, pivots=6, annulus=16)
    assert rows(got.select("query_id", "rank", "vec_id", "score")) == brute_top_k(v)


def test_top_k_reads_few_annuli(spark, scratch):
    """Groups far from a query lie outside its bound and are not read."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(20, 16))
    centres *= 50 / np.linalg.norm(centres, axis=1)[:, None]
    v = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.3 * r.normal(size=16)]) for i in range(2400)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    index = topk_search.Index(topk_search.integers(df), scratch, 64, 8)
    got, blocks, read = topk_search.search(index, index.vectors.filter("vec_id % 100 = 0"), 10)
    assert rows(got.select("query_id", "rank", "vec_id", "score")) == brute_top_k(v)
    n, each = index.blocks.count(), read.count()
    assert n >= 300 and each == read.distinct().count() and each < 0.7 * n * blocks.count()
    print("annuli read:", each / (n * blocks.count()))


def test_top_k_edges(spark, scratch):
    schema = "vec_id long, embedding array<float>"
    run = lambda v: rows(topk_search.top_k(spark.createDataFrame(v, schema), F.col("vec_id") % 100 == 0, scratch).select("query_id", "rank", "vec_id", "score"))
    assert run([]) == [] and run([(100, [1.0])]) == []
    big = [(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [-2.0, 1.0])]
    assert run(big)[0] == (0, 1, 1, 2**63 - 1)
    assert run([(0, [2.0]), (7, [1.0]), (7, [1.0]), (9, [1.0])]) == [(0, 1, 7, 2048 * 1024), (0, 2, 7, 2048 * 1024), (0, 3, 9, 2048 * 1024)]


# Quality classifier


def test_ordinal_classifier(spark):
    r = random.Random(1)
    text = lambda g: " ".join(r.choice(["good", "fine", "clear"][g % 3 : g % 3 + 1] * 3 + words(3, r.random())) for _ in range(60))
    graded = [(i, i % 3, text(i % 3)) for i in range(300)]
    docs = corpus(spark, [(i, t) for i, _, t in graded] + [(900, None), (901, ""), (902, "fine " * 20_000)])
    labels = spark.createDataFrame([(i, g) for i, g, _ in graded if i < 200] + [(None, 1), (5, None)], "doc_id long, grade int")
    model = quality_classifier.fit_on(docs, labels, F.col("grade"), 2)
    assert model.thresholds[0] < model.thresholds[1]
    out = {x.doc_id: x for x in quality_classifier.score_documents(docs, model, keep_grade=2).collect()}
    assert len(out) == 303 and out[0].value == "v"
    order = [np.mean([out[i].expected_grade for i, g, _ in graded[200:] if g == k]) for k in range(3)]
    assert order[0] < order[1] - 0.3 < order[2] - 0.6
    assert all(0 <= x.tail <= x.expected_grade <= 2 for x in out.values()) and out[900].tail == out[901].tail


def plain_likelihood(theta, rows, grades, penalty):
    """Text by text, as the formula says."""
    w, first, gaps = theta[: quality_classifier.BUCKETS], theta[quality_classifier.BUCKETS], np.exp(theta[quality_classifier.BUCKETS + 1 :])
    cuts = [first + sum(gaps[:k]) for k in range(len(gaps) + 1)]
    total = 0.0
    for (at, weight), g in zip(rows, grades):
        z = sum(w[a] * x for a, x in zip(at, weight))
        above = [1.0, *(1 / (1 + np.exp(c - z)) for c in cuts), 0.0]
        total += np.log(above[g] - above[g + 1])
    return total / len(rows) - penalty / 2 * sum(w**2)


def test_ordinal_likelihood_and_gradient():
    r = np.random.default_rng(5)
    texts = ["", "a b c", "b b b a", "good text", "é 🙂 x"]
    rows, grades = [quality_classifier.hashed(t) for t in texts], np.array([0, 1, 2, 2, 1])
    theta = r.normal(size=quality_classifier.BUCKETS + 2) * 0.3
    value, grad = quality_classifier.likelihood(theta, quality_classifier.Design.of(rows), grades, 0.01)
    assert np.isclose(value, plain_likelihood(theta, rows, grades, 0.01))
    for i in [*rows[1][0][:3], *rows[4][0][:2], quality_classifier.BUCKETS, quality_classifier.BUCKETS + 1]:
        e = np.zeros_like(theta)
        e[i] = 1e-5
        slope = (plain_likelihood(theta + e, rows, grades, 0.01) - plain_likelihood(theta - e, rows, grades, 0.01)) / 2e-5
        assert np.isclose(grad[i], slope, atol=1e-6)


def test_ordinal_scores_by_hand(spark):
    model = quality_classifier.fit([quality_classifier.hashed(t) for t in ["x y", "z w"]], np.array([0, 2]), 2, 50)
    docs = clashing(corpus(spark, [(1, "x y"), (2, "z w z"), (3, None), (3, None), (None, "")]))
    out = unclashed(quality_classifier.score_documents(docs, model), docs.columns).collect()
    assert len(out) == 5
    for r in out:
        at, weight = quality_classifier.hashed({1: "x y", 2: "z w z"}.get(r.doc_id, ""))
        z = sum(model.weights[a] * v for a, v in zip(at, weight))
        tails = [1 / (1 + np.exp(c - z)) for c in model.thresholds]
        assert np.isclose(r.tail, tails[0]) and np.isclose(r.expected_grade, sum(tails)) and r.quality_kept == (tails[0] >= 0.5)


def test_labelled_sample_is_bounded(spark):
    from tablewright.llm.labelled import labelled_sample

    docs = corpus(spark, [(i, "x" * 10) for i in range(20)] + [(20, "y" * 10_000)])
    labels = spark.createDataFrame([(i, 1) for i in range(21)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, F.col("toxic"), 5).count() == 5
    some = labelled_sample(docs, labels, F.col("toxic"), 100, chars=85).collect()
    assert sum(len(r.text) for r in some) <= 85
    assert labelled_sample(docs.limit(0), labels, F.col("toxic"), 5).count() == 0


def test_classifier_without_labels(spark):
    docs = corpus(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs, none).collect()
    assert len(out) == 2 and all(r.quality_kept for r in out)
    assert quality_classifier.classify(docs.limit(0), none).count() == 0


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3
    model = quality_classifier.fit_on(docs, labels.filter(~held), quality_classifier.rating(), 2)
    test = quality_classifier.score_documents(docs.join(labels.filter(held), "doc_id"), model).select("quality", "quality_kept").collect()
    assert np.mean([r.quality_kept == bool(r.quality) for r in test]) > 0.97


# Quality rules


def brute_counts(t):
    w = SPLIT.findall(t or "")
    c, covered = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, scratch):
    eight = " ".join("abcdefgh")
    texts = [None, "", " \t\n", "a " * 9, eight, f"{eight} {eight}", f"{eight} x {eight}\n{eight} x", "l\nl\n l\n\n\nl", "é ü# **\x0bx\x1cy z", "|" * 50_000, " ".join(words(30_000, 3)), ("p q r s t u v w x y\n" * 400)]
    out = {r.doc_id: r for r in quality_rules.judge(corpus(spark, list(enumerate(texts))), scratch).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        n = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, t and t[:40]
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
    assert out[0].value == "v" and quality_rules.judge(corpus(spark, []), scratch).count() == 0


def test_outliers(spark, scratch):
    r = random.Random(2)
    clean = [(i, " ".join(words(r.randint(40, 160), i))) for i in range(150)]
    odd = [(1000 + i, " ".join(w + "###***" for w in words(80, 5000 + i))) for i in range(12)]
    docs = corpus(spark, clean + odd).unionByName(corpus(spark, [(2000, " ".join(w + "$$$$" for w in words(60, 1)))], None, None))
    out = {x.doc_id: x for x in quality_rules.judge(docs, scratch, ["doc_id"]).collect()}
    assert all(out[i].quality_ok for i, _ in clean) and not any(out[i].quality_ok for i, _ in odd)
    assert not out[2000].quality_ok and out[2000].distance > 5  # alone in its group, judged by the estimate of all rows


def plain_verdict(docs):
    """Counting rules and MCD with exact quantiles, group by group; (kept, squared distance or None) by id."""
    x, base = {}, {}
    for i, t, lang, source in docs:
        n, chars, symbols, lines, repeat = brute_counts(t)
        base[i] = n < 20 or 100 * repeat > 30 * n
        if not base[i]:
            x[i] = np.array([np.log1p(n), np.log(chars / n), np.log1p(100 * symbols / chars), np.log1p(100 * lines / n), np.log1p(10 * repeat / n)])
    floor = np.array(quality_rules.FLOORS) ** 2

    def moments(v, factor):
        cov = np.cov(v.T, bias=True).reshape(5, 5) * factor
        np.fill_diagonal(cov, np.maximum(cov.diagonal(), floor))
        return v.mean(0), cov

    def lower(cov):
        low = np.zeros((5, 5))
        for j in range(5):
            low[j, j] = np.sqrt(max(cov[j, j] - low[j, :j] @ low[j, :j], 1e-9))
            for k in range(j + 1, 5):
                low[k, j] = (cov[k, j] - low[k, :j] @ low[j, :j]) / low[j, j]
        return low

    def squared(v, mean, cov):
        return (np.linalg.solve(lower(cov), (v - mean).T) ** 2).sum(0)

    def mcd(v):
        q = np.quantile(v, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        best = None
        for mean, cov in ((q[1], np.diag(np.maximum(((q[2] - q[0]) / 1.349) ** 2, floor))), moments(v, 1.0)):
            last = None
            while True:
                bins = np.minimum(quality_rules.LAST_BIN, np.floor(np.log1p(squared(v, mean, cov)) * quality_rules.BINS_A_LOG))
                inner = v[bins <= np.sort(bins)[int(np.ceil(len(v) * quality_rules.SHARE)) - 1]]
                new = moments(inner, quality_rules.CONSISTENCY)
                det = 2 * np.log(np.diag(lower(new[1]))).sum()
                if last is not None and det >= last[0]:
                    break
                last, (mean, cov) = (det, *new), new
            best = last if best is None or last[0] < best[0] else best
        return best[1], best[2], len(v)

    def shrink(own, up):
        part = own[2] / (own[2] + quality_rules.PRIOR_ROWS)
        return own[0] * part + up[0] * (1 - part), own[1] * part + up[1] * (1 - part), own[2]

    of = lambda test: mcd(np.array([x[i] for i, _, lang, source in docs if i in x and test(lang, source)]))
    top = of(lambda *_: True)
    out = {}
    for i, _, lang, source in docs:
        if base[i]:
            out[i] = False, None
            continue
        by_lang = shrink(of(lambda a, b: a == lang), top)
        own = shrink(of(lambda a, b: (a, b) == (lang, source)), by_lang)
        d2 = squared(x[i][None], own[0], own[1])[0]
        out[i] = d2 <= quality_rules.CUTOFF, d2
    return out


def test_verdicts_agree_with_plain_estimates(spark, scratch):
    r, docs = random.Random(11), []
    for i in range(160):
        w = words(r.randint(10, 150), 300 + i)
        if i % 9 == 0:
            w = [x + "#" * r.randint(0, 2) for x in w]
        docs.append((i, " ".join(w) + "\nq z\nq z" * (i % 13 == 0), ["en", "de", None][i % 3 if i % 5 else 0], ["a", "b", "rare"][min(i % 4, 2) if i > 20 else 0]))
    docs += [(900, None, "en", "a"), (901, "", None, None), (902, "w " * 30_000, "en", "a")]
    df = clashing(spark.createDataFrame([(i, t, a, b, None, "v") for i, t, a, b in docs], DOCS))
    got = {x.doc_id: x for x in unclashed(quality_rules.judge(df, scratch), df.columns).collect()}
    want = plain_verdict(docs)
    assert len(got) == len(docs)
    for i, (kept, d2) in want.items():
        assert (got[i].distance is None) == (d2 is None)
        if d2 is None:
            assert got[i].base_failed and not got[i].quality_ok
        else:
            assert np.isclose(got[i].distance**2, d2, rtol=0.02) and (got[i].quality_ok == kept or abs(d2 - quality_rules.CUTOFF) < 0.5)
    assert {kept for kept, _ in want.values()} == {True, False}


def test_small_groups_are_judged(spark, scratch):
    r = random.Random(3)
    docs = corpus(spark, [(i, " ".join(words(r.randint(40, 160), i))) for i in range(150)])
    for i, (lang, source) in enumerate([("en", "rare"), ("xx", "s"), (None, None)]):
        odd = [(1000 + i, " ".join(w + "$$$$" for w in words(60, i))), (2000 + i, " ".join(words(80, 900 + i)))]
        docs = docs.unionByName(corpus(spark, odd, lang, source))
    out = {x.doc_id: x for x in quality_rules.judge(docs, scratch, ["doc_id"]).collect()}
    assert all(x.distance is not None for x in out.values())
    assert not any(out[1000 + i].quality_ok for i in range(3)) and all(x.quality_ok for i, x in out.items() if not 1000 <= i < 2000)


def test_each_statistic_can_reject(spark, scratch):
    r = random.Random(4)
    clean = [(i, " ".join(words(r.randint(60, 160), i))) for i in range(150)]
    w, eight = words(100, 901), words(8, 900)
    symbols = " ".join(x + "#" * (i % 5 == 0) for i, x in enumerate(w))  # about 5 symbols per 100 characters
    lines = " ".join(w) + "\nq\nr\ns" * 5  # 12 repeated lines in 115 words
    repeated = " ".join([*eight, *w[:20], *eight, *w[20:40], *eight, *w[40:60], *eight, *w[60:78]])  # 32 of 110 words
    docs = corpus(spark, clean + [(1000, symbols), (1001, lines), (1002, repeated)])
    out = {x.doc_id: x for x in quality_rules.judge(docs, scratch, ["doc_id"]).collect()}
    assert all(out[i].quality_ok for i, _ in clean)
    assert not any(out[i].base_failed or out[i].quality_ok for i in (1000, 1001, 1002))


def test_estimates_agree_with_plain_concentration_steps(spark, scratch):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(size=(180, 5)) @ np.diag([1, 2, 0.5, 1, 3]), 9 + r.normal(size=(20, 5))])
    df = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, x1 double, x2 double, x3 double, x4 double, x5 double")
    est = quality_rules.mcd_estimates(df, scratch, steps=6).first()
    mean = np.array([est[f"m{i}"] for i in range(1, 6)])
    low = np.array([[est[f"l{i}{j}"] if j <= i else 0.0 for j in range(1, 6)] for i in range(1, 6)])
    d2 = (np.linalg.solve(low, (x - mean).T) ** 2).sum(0)
    keep = d2 <= np.sort(d2)[149] * 1.02
    assert np.allclose(mean, x[keep].mean(0), atol=0.1) and not keep[180:].any()


# BPE


def test_bpe_against_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, own = random.Random(7), bpe.tokenizer()
    tokens = [t.decode("utf-8", "ignore") for t in ranks]
    texts = ["", "<|endoftext|>", " " * 3000, "a" * 5000, "é" * 999, "日本語" * 300, "=" * 777, "\n\t  x", "🙂🙃" * 50]
    texts += ["".join(r.choice(tokens) for _ in range(r.randint(1, 40))) for _ in range(400)]
    texts += ["".join(r.choice("etaoin shrdlu'ls0123—é\n ") for _ in range(r.randint(1, 200))) for _ in range(400)]
    for t in texts:
        assert own.encode(t) == theirs.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()
    docs = corpus(spark, [*enumerate(texts), (7, None), (None, "x")])
    got = {x.doc_id: x for x in bpe.round_trip(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        if i != 7:
            ids = np.array(theirs.encode_ordinary(t), "<u4")
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoded = bpe.encode_documents(docs.filter("doc_id < 7"))
    assert {x.doc_id: bytes(x.decoded).decode() for x in bpe.decode_ids(encoded).collect()} == {i: texts[i] for i in range(7)}
    assert bpe.round_trip(docs.limit(0)).count() == 0


# Tool calls


def test_tool_calls(spark, scratch):
    schemas = {"f": {"a": ("integer", True), "b": ("array", False)}, "g": {"o": ("object", True), "n": ("number", False), "t": ("boolean", False)}}
    calls = [
        (1, "x", 0, "f", '{"b": [1, 2], "a": 1}'), (1, "y", 1, "f", '{"a": "1"}'), (1, "z", 2, "g", '{"o": {"k": 1, "j": null}, "n": 1.5, "t": true}'), (1, "x", 9, "f", "{}"), (2, "x", 0, "h", "{}"), (2, "u", 0, "f", "[1]"),
        (2, "v", 0, "f", "{broken"), (2, "w", 0, "f", None), (3, "c1", 0, "f", '{"a": 1}'), (3, "c2", 1, "f", '{"a": 2}'), (3, "c3", 2, "f", '{"a": 3, "q": 4}'), (None, "x", 0, "f", "{}"), (4, None, 0, "f", "{}"), (5, "m", 0, None, "{}"), (6, "k", 0, "f", '{"a": 1}'),
    ]
    needs = [(1, "z", "y"), (1, "y", "x"), (1, "z", "x"), (3, "c1", "c2"), (3, "c2", "c1"), (6, "k", "gone"), (1, "z", None)]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, tool string, arguments string").withColumn("id", F.lit("clash"))
    res = spark.createDataFrame([(1, "x", 5, "late"), (1, "x", 3, "r\"\n"), (1, "z", 4, None), (9, "x", 1, "no call"), (6, "k", 1, "r")], "conv_id long, call_id string, turn long, content string")
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link_tool_calls(c, res, spark.createDataFrame(needs, "conv_id long, call_id string, needed_id string"), schemas, scratch).collect()}
    assert len(out) == 12
    assert [(out[1, k].level, out[1, k].status, out[1, k].errors) for k in "xyz"] == [(0, "ok", ""), (1, "invalid", "type:a"), (2, "ok", "")]
    assert out[1, "x"].canonical == '{"arguments":{"a":1,"b":[1,2]},"id":"x","name":"f","result":"r\\"\\n"}'
    assert out[1, "z"].canonical == '{"arguments":{"n":1.5,"o":{"j":null,"k":1},"t":true},"id":"z","name":"g"}'
    assert [out[2, k].errors for k in "xuvw"] == ["unknown_tool", "not_an_object", "not_json", "not_json"]
    assert out[3, "c1"].status == out[3, "c2"].status == "cyclic" and out[3, "c3"].errors == "unknown:q"
    assert out[5, "m"].errors == "unknown_tool" and (out[6, "k"].status, out[6, "k"].missing_needs) == ("unmet", 1)


def test_derived_calls_hold_whole_texts(spark, scratch):
    texts = ['q"\\\n\t\x01é日🙂/', "x" * 5001, "", 'even"' * 2]
    turns = [(i, 2 * j + k, role, t) for i, t in enumerate(texts) for j in (0, 1) for k, role in enumerate(("user", "assistant"))] + [(9, 0, "system", "s"), (9, 5, "assistant", 'al"one')]
    calls, results, needs = tool_calls.derived_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    linked = tool_calls.link_tool_calls(calls, results, needs, tool_calls.SCHEMAS, scratch).unionByName(tool_calls.uncalled(calls, results))
    linked = scratch.table(linked, "linked")
    out, alone = linked.filter("conv_id < 9").collect(), linked.filter("conv_id = 9").collect()
    assert len(out) == 8
    for r in out:
        t, v = texts[r.conv_id], json.loads(r.canonical)
        assert v["arguments"] == ({"query": t, "limit": len(t)} if len(t) % 2 == 0 else {"text": t}) and v["result"] == t
    assert [(r.call_id, r.status, json.loads(r.canonical)) for r in alone] == [("call_4", "uncalled", {"id": "call_4", "result": 'al"one'})]
    md5 = {i: hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(texts)}
    for r in tool_calls.with_digests(linked).filter("conv_id < 9").collect():
        v = json.loads(r.canonical)
        assert v["result"] == md5[r.conv_id] and md5[r.conv_id] in v["arguments"].values()


def test_no_tool_calls(spark, scratch):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.link_tool_calls(*tool_calls.derived_calls(turns), tool_calls.SCHEMAS, scratch).count() == 0


# Toxicity


def test_marginals_over_gaps_equal_all_tokens():
    r = random.Random(3)
    chain = toxicity.Chain({"bad": 4.0, "^wor": 2.5}, -3.0, np.array([[0.8, -0.7], [-0.5, 0.9]]))
    for _ in range(30):
        text = [r.choice(["bad", "worse", "fine", "so", "and"]) for _ in range(r.randint(1, 40))]
        weights = [chain.weights[w] for w in text]
        emit = np.array([[chain.bias + (w or 0.0) for w in weights]])
        full, _, _ = toxicity._forward_backward(emit, chain.moves, np.array([len(text)]))
        at = [i for i, w in enumerate(weights) if w is not None]
        if at:
            assert np.allclose(chain.marginals(at, [weights[i] for i in at], len(text)), full[0, at], atol=1e-9)


def test_marginals_over_long_runs_of_a_sticky_chain(monkeypatch):
    """A chain that forgets slowly, over 5,000 tokens without features, and with a memory of two powers."""
    monkeypatch.setattr(toxicity, "POWERS_KEPT", 2)
    chain = toxicity.Chain({"bad": 9.0, "good": -9.0}, -0.0004, np.array([[8.5, 0.0], [0.0, 8.5]]))
    far, near = chain.power(1024), chain.power(5000)
    assert not np.allclose(far / far.sum(), near / near.sum(), atol=1e-3)
    for text in (["bad", *["so"] * 5000, "good", *["so"] * 3000], [*["so"] * 5000, "bad"], ["good", *["so"] * 2500, "bad", *["so"] * 1500, "bad"]):
        weights = [chain.weights[w] for w in text]
        emit = np.array([[chain.bias + (w or 0.0) for w in weights]])
        full, _, _ = toxicity._forward_backward(emit, chain.moves, np.array([len(text)]))
        at = [i for i, w in enumerate(weights) if w is not None]
        assert np.allclose(chain.marginals(at, [weights[i] for i in at], len(text)), full[0, at], atol=1e-8)


def test_likelihood_and_gradient_over_all_labellings():
    """Every labelling of short texts is summed up; segments without features count as often as they occur."""
    r = np.random.default_rng(2)
    names, marks = ["^bad", "bad", "worse"], {"bad", "^bad"}
    documents = [([["bad", "^bad"], [], ["worse"]], True), ([[], []], False), ([[], []], False), ([[]], False), ([["worse"], ["^bad"], [], []], True)]
    theta = r.normal(size=len(names) + 5)

    def plain(th):
        w, bias, moves, total = dict(zip(names, th)), th[3], th[-4:].reshape(2, 2), 0.0
        for tokens, toxic in documents:
            emit = [bias + sum(w[f] for f in fs) for fs in tokens]
            score = lambda y, emit=emit: sum(e * s for e, s in zip(emit, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))
            truth = [int(toxic and any(f in marks for f in fs)) for fs in tokens]
            total += score(truth) - np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=len(tokens))))
        return (total - 0.01 / 2 * (th @ th)) / len(documents)

    segments = toxicity.Segments(names, documents, marks)
    assert len(segments.length) == 4 and sorted(segments.weight) == [1, 1, 1, 2]
    value, grad = segments.likelihood(theta, 0.01)
    assert np.isclose(value, plain(theta))
    for i in range(len(theta)):
        e = np.zeros_like(theta)
        e[i] = 1e-5
        assert np.isclose(grad[i], (plain(theta + e) - plain(theta - e)) / 2e-5, atol=1e-6)


def test_document_score_by_all_labellings():
    """A document's score is the odds that not every token is clean, tokens taken one by one."""
    chain = toxicity.Chain({"bad": 2.0, "worse": 1.0}, -1.5, np.array([[0.5, -0.4], [-0.2, 0.6]]))
    words = ["so", "bad", "a", "worse", "b"]
    weight = {(y, t): np.exp((chain.bias + chain.of_feature.get(words[t], 0.0)) * y) for y in (0, 1) for t in range(5)}
    odds = {y: np.prod([weight[s, t] for t, s in enumerate(y)]) * np.exp(sum(chain.moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=5)}
    marginal = lambda t: sum(o for y, o in odds.items() if y[t]) / sum(odds.values())
    score, _ = chain.tag(" ".join(words))
    assert np.isclose(score, 1 - (1 - chain.neutral) * (1 - marginal(1)) * (1 - marginal(3)))


def test_offsets_where_lower_case_is_longer():
    chain = toxicity.Chain({"vile": 20.0, "stra\u00dfe": 20.0}, -3.0)
    for text in ("\u0130stanbul abc vile day", "e\u0301 \u0130\u0130 vile", "VILE \u0130", "vile\u0307 x", "STRA\u00dfE vile"):
        _, spans = chain.tag(text)
        assert spans and {text[a:b].lower() for a, b, _ in spans} <= {"vile", "stra\u00dfe"}
    assert [text for text in ("\u0130stanbul abc vile day",) for a, b, _ in chain.tag(text)[1] if text[a:b] == "vile"]


def test_only_near_copies_count_once():
    base = words(60, 1)
    near, far = [*base[:-1], "other"], [*base[:20], *words(40, 2)]
    assert toxicity.without_copies([base, base, near, far, words(60, 3), ["a"], []]) == [0, 3, 4, 5, 6]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_on(docs, labels)
    held = labels.filter(toxicity.fold(F.col("doc_id")) == 2)
    got = toxicity.tag_documents(docs.join(held, "doc_id"), model).select("toxic", "toxicity").collect()
    toxic, clean = [r.toxicity >= toxicity.THRESHOLD for r in got if r.toxic], [r.toxicity >= toxicity.THRESHOLD for r in got if not r.toxic]
    assert len(toxic) > 100 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.02


def test_toxic_spans(spark):
    r = random.Random(4)
    common = words(300, 8)
    made = [(i, i % 4 == 0, " ".join(r.choices(common, k=40) + (["vile", r.choice(["nastyone", "nastytwo"])] if i % 4 == 0 else []))) for i in range(300)]
    docs = corpus(spark, [(i, t) for i, _, t in made] + [(900, "You VILE thing, nastynew!"), (901, None), (902, ""), (903, "vile " * 3000)])
    labels = spark.createDataFrame([(i, int(y)) for i, y, _ in made], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    out = {x.doc_id: x for x in toxicity.tag_documents(docs, model).collect()}
    assert all((out[i].toxicity >= 0.3) == y for i, y, _ in made)
    odd = clashing(docs.filter("doc_id >= 900"))
    again = {x.doc_id: x for x in unclashed(toxicity.tag_documents(odd, model), odd.columns).collect()}
    assert len(again) == 4 and all(x.toxicity == out[i].toxicity and x.toxic_spans == out[i].toxic_spans for i, x in again.items())
    assert [(s.start, s.end) for s in out[900].toxic_spans] == [(4, 8), (16, 24)] and out[900].value == "v"
    assert out[901].toxicity == out[902].toxicity < 0.1 and len(out[903].toxic_spans) == 3000 and out[903].toxicity <= 1


def test_toxicity_without_labels(spark):
    docs = corpus(spark, [(1, "a vile b"), (2, None)])
    model = toxicity.fit_on(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.toxicity < 0.3 and not r.toxic_spans for r in toxicity.tag_documents(docs, model).collect())


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = corpus(spark, [(i, f"w{i} x") for i in range(100)])
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, toxic int")
    from tablewright.llm.labelled import labelled_sample

    ids = {r.doc_id for r in labelled_sample(docs, labels, F.col("toxic"), 1000, toxicity.fold(F.col("doc_id")) != 2).collect()}
    import zlib

    assert ids == {i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2}


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark, scratch):
    r = random.Random(6)
    sources = ["b", "a", "Z", "é", None, "tiny", "empty"]
    made = [(i, " ".join(words(r.randint(1, 30), i)), sources[min(int(r.expovariate(0.8)), 4)]) for i in range(3000)] + [(9000, "one", "tiny"), (9001, None, "empty"), (9002, "", "empty"), (None, "x y", "b"), (None, "x z", "b")]
    df = spark.createDataFrame([(i, t, "en", s, None, "v") for i, t, s in made], DOCS)
    out = mixing.with_copies(df, scratch).collect()
    assert len(out) == len(made)
    sizes, taken = collections.Counter(), collections.Counter()
    for x in out:
        assert x.mix_size == len(SPLIT.findall(x.text or "")) and 0 <= x.mix_copies <= 2
        sizes[x.source] += x.mix_size
        taken[x.source] += x.mix_size * x.mix_copies
    want = brute_targets(dict(sizes))
    for x in out:
        assert x.mix_source_size == sizes[x.source] and abs(x.mix_target - want[x.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 60 for s in want)
    odd = clashing(df)
    same = {(x.doc_id, x.mix_copies, x.mix_size) for x in unclashed(mixing.with_copies(odd, scratch), odd.columns).collect()}
    assert same == {(x.doc_id, x.mix_copies, x.mix_size) for x in out}
    assert mixing.mix(odd, scratch).columns == odd.columns
    again = mixing.mix(df.repartition(7), scratch)
    assert again.columns == df.columns and again.count() == sum(x.mix_copies for x in out)
    assert mixing.mix(df.limit(0), scratch).count() == 0


# URL lists


def test_url_lists(spark, scratch):
    entries = [("spam", "bad.org", 10, "add"), ("spam", "bad.org", 20, "remove"), ("spam", "bad.org", 30, "add"), ("adult", "x.bad.org", 15, "add"), ("spam", "org", 1, "add"), ("spam", None, 1, "add"), ("spam", "same.org", 5, "add"), ("spam", "same.org", 5, "remove"), ("spam", "host", 1, "add"), ("spam", "3.4", 1, "add"), ("spam", "1.2.3.4", 12, "add"), ("adult", "[2001:db8::1]", 1, "add")]
    e = spark.createDataFrame(entries, "list_name string, domain string, day int, action string")
    urls = ["http://bad.org/a", "HTTPS://U:p@X.BAD.org.:80/?q", "http://good.org", "nonsense", None, "http://same.org", "http://host/x", "http://notbad.org", "http://1.2.3.4:80/", "http://9.2.3.4/", "http://u@[2001:DB8::1]:8080/x", "http://a.b.c.d.bad.org/" + "p" * 100_000]
    captures = [(i * 100 + day, u, day) for i, u in enumerate(urls) for day in (9, 10, 19, 20, 30, 400)] + [(7, "http://bad.org", None)]
    df = spark.createDataFrame(captures, "page_id long, url string, fetch_day int").withColumn("lists", F.lit("clash"))

    def brute(u, day):
        m = re.match(r"[a-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", (u or "").lower())
        host, hits = m and m[1].removesuffix("."), set()
        if host and day is not None:
            parts = host.split(".")
            whole = host.startswith("[") or re.fullmatch(r"[0-9.]+", host)
            for dom in [host] if whole else [".".join(parts[k:]) for k in range(max(1, len(parts) - 1))]:
                for name in {"spam", "adult"}:
                    dated = sorted((d, a) for n, x, d, a in entries if n == name and x == dom and d <= day)
                    if dated and dated[-1][1] == "add":
                        hits.add((name, dom))
        return host or None, len(hits), ",".join(sorted({n for n, _ in hits})), bool(hits)

    got = url_lists.filter_captures(df, e, scratch)
    want = sorted(((i, brute(u, d)[0], d, *brute(u, d)[1:]) for i, u, d in captures), key=repr)
    assert rows(got) == want
    assert url_lists.filter_captures(df.limit(0), e.limit(0), scratch).count() == 0


# Faults found in use


def test_near_duplicates_link_rows_without_an_id(spark, scratch):
    base = words(60, 71)
    text = lambda k: " ".join([*base, f"end{k}"])
    docs = corpus(spark, [(None, text(1)), (5, text(2)), (7, text(3)), (None, " ".join(words(40, 72))), (None, " ".join([*words(40, 72), "more"])), (None, "")])
    out = near_dedup.near_duplicates(docs, scratch, width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
    assert rows(out) == sorted([(None, 60, 5, False), (5, 60, 5, True), (7, 60, 5, False), (None, 39, None, True), (None, 40, None, True), (None, 0, None, True)], key=repr)


def test_sample_loses_only_its_longest_texts(spark):
    docs = corpus(spark, [(i, "x" * (200 if i == 3 else 4)) for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = labelled.labelled_sample(docs, labels, F.col("quality"), 20, chars=100)
    assert [r.doc_id for r in got.collect()] == [i for i in range(20) if i != 3]


def test_long_texts_are_not_broadcast(spark, scratch, monkeypatch):
    from tablewright.llm import columns

    df = scratch.table(spark.createDataFrame([(1, "u" * 60), (2, None), (3, "v" * 60)], "id long, url string"), "roles")
    hinted = lambda d: "BROADCAST" in d._jdf.queryExecution().logical().toString().upper()
    assert hinted(columns.small(df, text=F.col("url"))) and not hinted(columns.small(df, rows=2))
    monkeypatch.setattr(columns, "BROADCAST_TEXT", 100)
    assert not hinted(columns.small(df, text=F.col("url"))) and hinted(columns.small(df))
