"""Toxic spans and document scores by a linear-chain conditional random field.

Two states, clean and toxic. A token's features are its lower-case form and its first three to seven letters. Token labels
for training come from labelled documents: tokens with a feature that explains toxic documents and hardly occurs in clean
ones. Near copies count once there, so the other words of a toxic text that is often copied aren't taken for
toxic. Forward-backward marginals tag tokens and aggregate to a document
score. Runs of tokens without features have one transition matrix each step, so its powers carry the chain over them.
Offsets are those of the text as it is: it is split into tokens first, and each token is lowered by itself.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.columns import packed, unpacked
from tablewright.llm.labelled import labelled_sample

#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 6_000
PREFIXES = (3, 4, 5, 6, 7)
#: A feature is used from so many toxic documents and this share of toxic among its documents; one that marks token
#: labels must be nearly pure.
LEAST_SUPPORT, LEAST_SHARE, LABEL_SHARE = 3, 0.8, 0.95
#: Odds that any feature at all is taken for toxic by chance.
CHANCE = 0.05
#: The penalty is on the likelihood of all segments together, so it weighs no more where there are many.
SEGMENT, STEPS, RATE, PENALTY = 64, 80, 0.2, 0.1
THRESHOLD, SPAN = 0.3, 0.5
TOKEN = re.compile(r"\w+")
WORDS_KEPT, POWERS_KEPT = 500_000, 4_096
#: Share of word triples that near copies have in common.
COPY_SHARE = 0.8


def words_of(text: str) -> list[str]:
    """The text's tokens in lower case, as many as ``TOKEN`` finds in the text itself."""
    # Lower-casing may change the number of tokens, but not that of ASCII.
    return TOKEN.findall(text.lower()) if text.isascii() else [w.lower() for w in TOKEN.findall(text)]


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


class Weights(dict):
    """Summed feature weight of each word met, or None for a word without features; emptied when full."""

    def __init__(self, of_feature: dict[str, float]):
        super().__init__()
        self.of_feature = of_feature

    def __missing__(self, word: str) -> float | None:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = [self.of_feature[f] for f in features(word) if f in self.of_feature]
        self[word] = known = sum(found) if found else None
        return known


@dataclass
class Chain:
    """Log weights of features, of the toxic state itself, and of transitions from row to column."""

    of_feature: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self):
        self.weights = Weights(self.of_feature)
        step = np.exp(self.moves) * np.array([1.0, np.exp(self.bias)])
        self.scale = float(max(abs(np.linalg.eigvals(step))))
        self.step, self.move = step / self.scale, np.exp(self.moves)
        self.powers: dict[int, np.ndarray] = {}
        start = np.array([1.0, np.exp(self.bias)])
        self.start = start
        far = self.power(64)
        rest = (start @ far) * far.sum(1)
        self.neutral = float(rest[1] / rest.sum())  # a token far from any feature

    def power(self, n: int) -> np.ndarray:
        """Transitions over n tokens without features, for runs of any length; those met are remembered, and forgotten when many."""
        if n not in self.powers:
            if len(self.powers) >= POWERS_KEPT:
                self.powers.clear()
            self.powers[n] = np.linalg.matrix_power(self.step, n)
        return self.powers[n]

    def marginals(self, places: list[int], weights: list[float], length: int) -> np.ndarray:
        """P(toxic) of the tokens at ``places``, as forward-backward over all ``length`` tokens gives it."""
        forward, backward = np.empty((len(places), 2)), np.empty((len(places), 2))
        lift = np.exp(np.clip(np.array(weights) + self.bias, -50, 50))
        a = self.start if places[0] else None
        if places[0]:
            a = self.start @ self.power(places[0] - 1)
        for i, (at, up) in enumerate(zip(places, lift)):
            if i and at - places[i - 1] > 1:
                a = a @ self.power(at - places[i - 1] - 1)
            a = np.array([1.0, up]) if a is None else (a @ self.move) * np.array([1.0, up])
            a = a / a.sum()
            forward[i] = a
        b = self.power(length - 1 - places[-1]).sum(1)
        for i in range(len(places) - 1, -1, -1):
            backward[i] = b / b.sum()
            if i:
                b = self.move @ (np.array([1.0, lift[i]]) * backward[i])
                if places[i] - places[i - 1] > 1:
                    b = self.power(places[i] - places[i - 1] - 1) @ b
        both = forward * backward
        return both[:, 1] / both.sum(1)

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score and (start, end, P) of its toxic tokens. Offsets count characters of the text."""
        words = words_of(text)
        found = [(i, w) for i, w in enumerate(map(self.weights.__getitem__, words)) if w is not None]
        if not found:
            return self.neutral, []
        p = self.marginals([i for i, _ in found], [w for _, w in found], len(words))
        score = 1 - (1 - self.neutral) * float(np.prod(1 - np.clip(p, 0, 1)))
        toxic = {i: q for (i, _), q in zip(found, p) if q >= SPAN}
        if not toxic:
            return score, []
        spans = [(m.start(), m.end(), float(toxic[i])) for i, m in enumerate(TOKEN.finditer(text)) if i in toxic]
        return score, spans


def without_copies(tokens: list[list[str]]) -> list[int]:
    """Places of documents, one of each group of near copies.

    Documents that share a minimum of four hashes over their word triples are compared, and are copies if they share
    ``COPY_SHARE`` of their triples; a document is compared with those that stand for a group, not with each member.
    """
    kept: list[int] = []
    sets: dict[int, frozenset[bytes]] = {}
    seen: set[frozenset[bytes]] = set()
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, words in enumerate(tokens):
        triples = frozenset(" ".join(words[j : j + 3]).encode() for j in range(max(1, len(words) - 2)))
        if triples in seen:
            continue
        seen.add(triples)
        least = [(seed, min(zlib.crc32(t, seed * 0x9E3779B9 & 0xFFFFFFFF) * (2 * seed + 0x9E3779B1) & 0xFFFFFFFF for t in triples)) for seed in range(4)]
        others = {k for key in least for k in holders[key]}
        if any(len(triples & sets[k]) >= COPY_SHARE * len(triples | sets[k]) for k in others):
            continue
        kept.append(i)
        sets[i] = triples
        for key in least:
            holders[key].append(i)
    return kept


def marking(toxic: list[set[str]], clean: Counter, n_clean: int) -> set[str]:
    """Features that mark a token as toxic, from documents without copies; nearly all documents that have one are toxic.

    First those that explain the toxic documents: greedily the feature that is in most of those not yet explained. Then
    every other that is in more toxic documents than chance would give any feature at all.
    """
    holders: dict[str, set[int]] = defaultdict(set)
    for i, d in enumerate(toxic):
        for f in d:
            holders[f].add(i)
    pure = {f: h for f, h in holders.items() if len(h) >= LEAST_SUPPORT and len(h) / (len(h) + clean[f]) >= LABEL_SHARE}
    share = len(toxic) / max(1, len(toxic) + n_clean)
    tried = sum(len(h) + clean[f] >= LEAST_SUPPORT for f, h in holders.items())
    unlikely = math.log(CHANCE / max(1, tried)) / math.log(min(share, 0.9)) if toxic else 0
    chosen = {f for f, h in pure.items() if len(h) >= unlikely}
    left = dict(pure)
    while left:
        # Among equals the longer, more particular feature.
        f = max(left, key=lambda x: (len(left[x]), len(x), x))
        if len(left[f]) < LEAST_SUPPORT:
            break
        chosen.add(f)
        gone = left.pop(f)
        left = {g: h - gone for g, h in left.items()}
    return chosen


def _forward_backward(emit: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (n, T) of the toxic state, expected transitions (n, 2, 2) and log normalisers (n) of padded segments."""
    n, width = emit.shape
    move = np.exp(moves)
    lift = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -50, 50))], 2)
    alive = np.arange(width)[None, :] < lengths[:, None]
    a, b = np.empty((n, width, 2)), np.ones((n, width, 2))
    scale = np.empty((n, width))
    for t in range(width):
        x = (a[:, t - 1] @ move) * lift[:, t] if t else lift[:, 0]
        scale[:, t] = x.sum(1)
        a[:, t] = x / scale[:, t, None]
    for t in range(width - 2, -1, -1):
        x = (lift[:, t + 1] * b[:, t + 1]) @ move.T
        b[:, t] = np.where(alive[:, t + 1, None], x / x.sum(1, keepdims=True), 1.0)
    both = a * b
    p = both[:, :, 1] / both.sum(2)
    pair = a[:, :-1, :, None] * move[None, None] * (lift[:, 1:] * b[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p, (pair * alive[:, 1:, None, None]).sum(1), (np.log(scale) * alive).sum(1)


class Segments:
    """Labelled runs of up to ``SEGMENT`` tokens. Those without features are alike but for their length, so each length is
    one row that weighs as many as it stands for.
    """

    def __init__(self, names: list[str], documents: list[tuple[list[list[str]], bool]], marks: set[str]):
        """``documents`` hold the features of each token and whether they are toxic."""
        number = {f: i for i, f in enumerate(names)}
        at, columns, labels, lengths = [], [], [], []
        plain: Counter = Counter()
        for tokens, toxic in documents:
            for start in range(0, len(tokens), SEGMENT):
                part = [[f for f in fs if f in number] for fs in tokens[start : start + SEGMENT]]
                if not any(part):
                    plain[len(part)] += 1
                    continue
                label = np.zeros(SEGMENT, dtype=int)
                for t, fs in enumerate(part):
                    label[t] = toxic and any(f in marks for f in fs)
                    at += [len(lengths) * SEGMENT + t] * len(fs)
                    columns += [number[f] for f in fs]
                labels.append(label)
                lengths.append(len(part))
        self.weight = np.array([1.0] * len(lengths) + list(plain.values()))
        self.length = np.array(lengths + list(plain), dtype=int)
        self.label = np.array(labels + [np.zeros(SEGMENT, dtype=int)] * len(plain)).reshape(-1, SEGMENT)
        self.at, self.column, self.n = np.array(at, dtype=int), np.array(columns, dtype=int), len(names)
        self.alive = np.arange(SEGMENT)[None, :] < self.length[:, None]
        self.seen = np.zeros((2, 2))
        steps = self.alive[:, 1:]
        np.add.at(self.seen, (self.label[:, :-1][steps], self.label[:, 1:][steps]), np.broadcast_to(self.weight[:, None], steps.shape)[steps])

    def likelihood(self, theta: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
        """Log likelihood of the labels less the penalty, and its gradient, both by segment; ``theta`` is weights, bias, moves."""
        w, bias, moves = theta[: self.n], theta[self.n], theta[-4:].reshape(2, 2)
        emit = bias + np.bincount(self.at, w[self.column], self.label.size).reshape(self.label.shape)
        p, expected, log_z = _forward_backward(emit, moves, self.length)
        weight, total = self.weight[:, None], self.weight.sum()
        off = (self.label - p) * self.alive * weight
        value = ((self.label * emit * self.alive).sum(1) - log_z) @ self.weight + (self.seen * moves).sum()
        moved = self.seen - (expected * self.weight[:, None, None]).sum(0)
        grad = np.concatenate([np.bincount(self.column, off.ravel()[self.at], self.n), [off.sum()], moved.ravel()])
        return (value - penalty * (theta @ theta) / 2) / total, (grad - penalty * theta) / total


def fit(texts: list[str], toxic: list[int]) -> Chain:
    """Labels tokens, then fits the chain by Adam on segments. Without toxic examples, nothing is ever toxic."""
    # One object for each word, however often it occurs.
    tokens = [[sys.intern(w) for w in words_of(t)] for t in texts]
    known = {w: features(w) for w in {w for words in tokens for w in words}}
    of = lambda words: {f for w in set(words) for f in known[w]}
    labelled = [i for i, y in enumerate(toxic) if y]
    single = [of(tokens[labelled[i]]) for i in without_copies([tokens[i] for i in labelled])]
    clean: Counter = Counter()
    for words, y in zip(tokens, toxic):
        if not y:
            clean.update(of(words))
    marks = marking(single, clean, len(texts) - len(labelled))
    if not marks:
        return Chain()
    support = Counter(f for s in single for f in s)
    names = sorted(marks | {f for f, n in support.items() if n >= LEAST_SUPPORT and n / (n + clean[f]) >= LEAST_SHARE})
    segments = Segments(names, [([known[w] for w in words], bool(y)) for words, y in zip(tokens, toxic)], marks)
    theta = np.concatenate([np.zeros(len(names)), [-3.0], np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, grad = segments.likelihood(theta)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(dict(zip(names, theta[: len(names)].tolist())), float(theta[len(names)]), theta[-4:].reshape(2, 2).copy())


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit_on(docs: DataFrame, labels: DataFrame, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fits on at most ``sample_rows`` labelled documents outside the fold ``held_out``."""
    sample = labelled_sample(docs, labels, F.col("toxic"), sample_rows, fold(F.col("doc_id")) != held_out)
    texts: list[str] = []
    toxic: list[int] = []
    for row in sample.toLocalIterator():
        texts.append(row.text)
        toxic.append(int(row.grade >= 1))
    return fit(texts, toxic)


def tag_documents(docs: DataFrame, model: Chain) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and toxic_spans (start, end, p). Only the text is read; null is the empty text.

    One map over whole texts, however long; all columns stay, repeated rows too, and an empty table gives none. Offsets count
    characters of the text. Where ``docs`` has a column named like an output, that output has an underscore after its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.of_feature, model.bias, model.moves))
    made: dict[int, Chain] = {}

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = made.setdefault(0, Chain(*shared.value))
        for texts in batches:
            tags = [own.tag(t or "") for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in tags], "spans": [[{"start": a, "end": b, "p": p} for a, b, p in spans] for _, spans in tags]})

    out = packed(docs, tagged(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("crf"))
    return unpacked(out, docs.columns, toxicity=F.col("crf.score"), toxic_spans=F.col("crf.spans"))


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity and toxic spans of every row of ``documents``, learnt outside the held-out fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = tag_documents(docs.select("doc_id", "text"), fit_on(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "toxic_spans")
