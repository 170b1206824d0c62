"""Prefix-free parsing of one block of texts: rolling-hash triggers, their phrases, and suffix arrays of a dictionary.

A trigger is a string of ``TRIGGER`` bytes whose rolling hash is the least of some window's; every window of ``WINDOW`` bytes
holds one at least. A phrase reaches from a trigger as far to both sides as a window that holds the trigger can, so each
window lies whole within a phrase and neighbouring phrases overlap. Distinct phrases are the dictionary, their sequence in
a text is its parse.

Everything here works on numpy arrays over the bytes of a block of whole texts, one after another; nothing crosses the
border of two texts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

#: Bytes of a match, and of the strings that trigger a phrase.
WINDOW, TRIGGER = 50, 20
#: Places that a trigger can have in a window; bytes of a phrase before its trigger's start and from there on.
PLACES = WINDOW - TRIGGER + 1
BEFORE, AFTER = PLACES - 1, WINDOW
#: Windows that are hashed at once.
CHUNK = 1 << 18

_NUMBERS = np.random.default_rng(11).integers(0, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@functools.cache
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a rolling hash's base and of its inverse, modulo 2**64."""
    base, size = _BASES[which], CHUNK + 2 * WINDOW
    up, down = (np.full(size, np.uint64(b), np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return np.cumprod(up), np.cumprod(down)


def rolling(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash, never 0, of each ``width`` bytes of ``data`` (a chunk)."""
    up, down = _powers(which)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_NUMBERS[which][data] * up[: len(data)])])
    h = (sums[width:] - sums[:-width]) * down[: max(0, len(data) - width + 1)]
    return mixed(h) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slide(a: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """``f`` (minimum or maximum) over each ``width`` entries in a row."""
    span = 1
    while 2 * span <= width:
        a = f(a[:-span], a[span:])
        span *= 2
    return f(a[: len(a) - width + span], a[width - span :]) if width > span else a


class Block:
    """Texts in a row: bytes, where each text begins, and for every byte the bytes of its text before it and from it on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        sizes = np.diff(offsets)
        self.text_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        at = np.arange(len(data), dtype=np.int32)
        self.behind = at - np.repeat(offsets[:-1].astype(np.int32), sizes)
        self.ahead = np.repeat(offsets[1:].astype(np.int32), sizes) - at
        self.is_window = self.ahead >= WINDOW

    def _chunks(self):
        for at in range(0, len(self.data) - WINDOW + 1, CHUNK):
            yield at, self.data[at : at + CHUNK + WINDOW - 1]

    def triggers(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all triggers, in order."""
        places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for at, data in self._chunks():
            h = rolling(data, TRIGGER)
            least = _slide(h, PLACES, np.minimum)
            least[~self.is_window[at : at + len(least)]] = 0
            edge = np.zeros(PLACES - 1, np.uint64)
            met = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), PLACES, np.maximum) == h)
            places.append(at + met)
            hashes.append(h[met])
        # Windows of two chunks can have a trigger in common.
        places, first = np.unique(np.concatenate(places), return_index=True)
        # Triggers have small hashes; mixed again, these are spread evenly over buckets.
        return places, mixed(np.concatenate(hashes)[first])

    def windows(self, which: int) -> np.ndarray:
        """A hash of each window by its start; 0 where no window starts."""
        out = np.zeros(len(self.data), np.uint64)
        for at, data in self._chunks():
            h = rolling(data, WINDOW, which)
            out[at : at + len(h)] = h
        out[~self.is_window] = 0
        return out

    def reach(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each trigger's phrase before its start and from there on: less than usual at the ends of a text."""
        return np.minimum(self.behind[places], BEFORE), np.minimum(self.ahead[places], AFTER)

    def phrases(self, places: np.ndarray) -> np.ndarray:
        """A row of ``BEFORE + AFTER`` bytes for each trigger, 0 beyond the text's ends."""
        before, after = self.reach(places)
        padded = np.concatenate([np.zeros(BEFORE, np.uint8), self.data, np.zeros(AFTER, np.uint8)])
        out = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + AFTER)[places]
        for step in range(BEFORE + AFTER):
            out[(step < BEFORE - before) | (step >= BEFORE + after), step] = 0
        return out

    def phrase_hashes(self, places: np.ndarray) -> np.ndarray:
        """A hash of each trigger's phrase, from sums over the block."""
        before, after = self.reach(places)
        out = np.zeros(len(places), np.uint64)
        up, down = _powers(1)
        # Chunks overlap by a phrase.
        for at in range(0, len(self.data), CHUNK):
            i = np.flatnonzero((places >= at) & (places < at + CHUNK))
            low = max(0, at - BEFORE)
            data = self.data[low : at + CHUNK + AFTER]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_NUMBERS[1][data] * up[: len(data)])])
            start, end = places[i] - before[i] - low, places[i] + after[i] - low
            out[i] = (sums[end] - sums[start]) * down[start]
        return mixed(out + mixed(before.astype(np.uint64) * np.uint64(256) + after.astype(np.uint64)))


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, inverse, least, several) of distinct keys: an index of each, whose key each entry has, the least document, and whether it has more."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    least, most = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, docs)
    np.maximum.at(most, inverse, docs)
    return first, inverse, least, least < most


def _suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` of bytes, and how many leading bytes each shares with the one before it in that order."""
    width = rows.shape[1]
    padded = np.zeros((len(rows), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    differs = rows[order[1:]] != rows[order[:-1]]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return order, np.concatenate([np.zeros(1, np.int64), shared])


def repeated_places(phrases: np.ndarray, before: np.ndarray, after: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each dictionary phrase a bit set of the windows in it that a smaller document has, by bytes before the trigger.

    The dictionary has two suffix arrays here, each with the lengths that neighbours share: one of what follows from the
    triggers on, one of what stands before them, read backwards. Cut at a depth they number equal strings alike, and a window
    is a depth in each. Within a number the parse is in the order of its documents, of which the least counts.
    """
    forward, along = _suffix_order(phrases[:, BEFORE:])
    backward, aback = _suffix_order(phrases[:, BEFORE - 1 :: -1])
    out = np.zeros(len(phrases), np.uint32)
    follows, precedes = np.empty(len(phrases), np.int64), np.empty(len(phrases), np.int64)
    for y in range(PLACES):
        valid = np.flatnonzero((before >= y) & (after >= WINDOW - y))
        if len(valid) < 2:
            continue
        follows[forward] = np.cumsum(along < WINDOW - y)
        precedes[backward] = np.cumsum(aback < y)
        key = (follows * (len(phrases) + 1) + precedes)[valid]
        order = np.argsort(key, kind="stable")
        key, doc = key[order], docs[valid][order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(key))))
        out[valid[order[least < doc]]] |= np.uint32(1 << y)
    return out
