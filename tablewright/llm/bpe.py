"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is the merge result of a piece exactly when every adjacent pair is itself what merging that pair's
bytes gives. So each piece is walked from its longest vocabulary match, and a step goes back to a shorter one where the
pair with the token before is incompatible; pair checks are memoised, and a position found dead is never tried again,
which keeps the walk linear. Bytes are matched as Latin-1 text, one character a byte.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces and pairs remembered by a Python worker. A full memory of pieces becomes the old one, from which those still in
#: use are taken over; a full memory of pairs is emptied.
PIECES_KEPT, PAIRS_KEPT = 250_000, 1_000_000
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    """Encoder and decoder over a tiktoken rank file and a split pattern."""

    def __init__(self, vocabulary: str, pattern: str):
        import ahocorasick
        import regex

        self.split = regex.compile(pattern)
        with open(vocabulary, "rb") as lines:
            self.rank = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.bytes_of = {rank: token.encode("latin-1") for token, rank in self.rank.items()}
        self.size_of = {rank: len(token) for token, rank in self.rank.items()}
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.matcher.add_word(token, rank)
        self.matcher.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.old_pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals; only for the bytes of one pair of tokens."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging the two tokens' bytes gives these two again; the answer is remembered."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        text = (self.bytes_of[pair[0]] + self.bytes_of[pair[1]]).decode("latin-1")
        known = self.pairs[pair] = self.merged(text) == [*pair]
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1; the answer is remembered."""
        text = self.bytes_of[token].decode("latin-1")
        known = self.shorter[token] = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), -1)
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one Latin-1 piece. A piece that is a token is that token."""
        if piece in self.rank:
            return (self.rank[piece],)
        n, size_of, known, shorter = len(piece), self.size_of, self.pairs.get, self.shorter.get
        longest = [-1] * n
        for end, token in self.matcher.iter(piece):
            longest[end - size_of[token] + 1] = token  # later ends are longer
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + size_of[token]
                if alive[end]:
                    if not out:
                        break
                    fits = known(pair := (out[-1], token))
                    if self.compatible(pair) if fits is None else fits:
                        break
                next_token = shorter(token)
                token = self.next_shorter(token) if next_token is None else next_token
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a single byte of this piece")
                alive[at] = 0
                token = out.pop()
                at -= size_of[token]
        return tuple(out)

    def remember(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that is not in the younger memory."""
        ids = self.old_pieces.get(piece)
        if ids is None:
            ids = self.encode_piece(piece.encode("utf-8").decode("latin-1"))
        if len(piece) <= 64:
            if len(self.pieces) >= PIECES_KEPT:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split.findall(text):
            ids += self.pieces.get(piece) or self.remember(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(vocabulary: str | None = None, pattern: str | None = None) -> ByteBpe:
    """The worker's own encoder, made once a process. By default the public 50k byte-level vocabulary."""
    import public_tokenizers

    key = (vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(*key)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; a null or empty text has no ids. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary, pattern)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, decoded (binary) of rows (doc_id, ids); null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(t.as_py() or []) for t in batch.column(1)], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of the ids of every whole text and of the bytes that those ids decode to, in one pass over the texts.

    A null or empty text has no ids and decodes to no bytes. Null ids stay null. Repeated rows each give a row, alike. Very long
    texts are encoded whole. Columns other than doc_id and text are ignored, whatever their names. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST_SCHEMA)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
