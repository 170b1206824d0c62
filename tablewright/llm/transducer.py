"""Minimal acyclic transducers: a sorted vocabulary as an automaton whose paths add up to lexicographic ordinals.

States with equal futures are one state. An edge's output is the number of terms that come before those beyond it, so the
outputs along a term's path sum to its place in the vocabulary. Texts are walked through a transducer all tokens at once,
a byte a step; a token leaves at the first byte that no term has.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def minimal_transducer(terms: Sequence[bytes]) -> dict[str, np.ndarray]:
    """keys (state * 256 + byte), targets and outputs of the edges, and finals of the states; the last state is the root.

    ``terms`` are sorted by their bytes, without repeats. Only the path of the term at hand is open; what lies behind it is
    closed, and closed states that are equal become one.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    counts: list[int] = []
    path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
    last = b""

    def closed(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, *edges)
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(final)
            counts.append(final + sum(counts[t] for _, t in edges))
        return state

    def close_to(depth: int) -> None:
        while len(path) > depth + 1:
            (final,), edges = path.pop()
            path[-1][1].append((last[len(path) - 1], closed(final, edges)))

    for term in terms:
        common, most = 0, min(len(last), len(term))
        while common < most and last[common] == term[common]:
            common += 1
        close_to(common)
        path.extend(([False], []) for _ in term[common:])
        path[-1][0][0] = True
        last = term
    close_to(0)
    (final,), edges = path[0]
    # The root is a state of its own, so that it is the last.
    register[(final, *edges, "root")] = len(finals)
    finals.append(final)
    keys, targets, outputs = [], [], []
    for key, state in register.items():
        before = int(key[0])
        for byte, target in (e for e in key[1:] if e != "root"):
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(before)
            before += counts[target]
    return {"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "outputs": np.array(outputs, np.int64), "finals": np.array(finals, bool)}


def packed_transducer(parts: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **parts)
    return out.getvalue()


class Transducer:
    """A packed transducer made ready to walk: its edges in a table of open addresses."""

    def __init__(self, blob: bytes):
        with np.load(io.BytesIO(blob)) as parts:
            self.keys, self.targets, self.outputs, self.finals = (parts[k] for k in ("keys", "targets", "outputs", "finals"))
        bits = max(4, (4 * len(self.keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        at, left = self._address(self.keys), np.arange(len(self.keys), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]

    def _address(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def _edges(self, keys: np.ndarray) -> np.ndarray:
        """The edge of each key, or -1."""
        at = self._address(keys)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys)) if len(self.keys) else np.empty(0, np.int64)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found

    def ordinals(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary of each token ``data[start : start + size]``, or -1 for one that is no term."""
        out = np.full(len(starts), -1, np.int64)
        alive = np.arange(len(starts))
        state, total = np.full(len(starts), len(self.finals) - 1, np.int64), np.zeros(len(starts), np.int64)
        step = 0
        while len(alive):
            ended = sizes[alive] == step
            if ended.any():
                done = ended & self.finals[state]
                out[alive[done]] = total[done]
                alive, state, total = alive[~ended], state[~ended], total[~ended]
            edge = self._edges(state * 256 + data[starts[alive] + step])
            on = edge >= 0
            edge = edge[on]
            alive, state, total = alive[on], self.targets[edge].astype(np.int64), total[on] + self.outputs[edge]
            step += 1
        return out
