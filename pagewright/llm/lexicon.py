"""A minimal acyclic transducer in one block of bytes: words to sequences of ids.

States with the same suffixes are one. Each edge knows how many words precede it below its state, so walking a
word adds up to its rank, and the rank finds its ids.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterable

import numpy as np

_HEAD = struct.Struct("<5Q")


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """entries: distinct words in the order of their bytes, with their ids."""
    root: dict = {}
    finals: dict[int, bool] = {}
    registry: dict[tuple, dict] = {}
    path: list[tuple[dict, int]] = []  # states on the last word's path below the root, with the labels that lead there
    last, ids, starts = b"", [], [0]

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            state, label = path.pop()
            parent = path[-1][0] if path else root
            key = (finals.get(id(state), False), tuple((b, id(s)) for b, s in state.items()))
            same = registry.setdefault(key, state)
            if same is not state:
                finals.pop(id(state), None)
                dead.append(state)  # kept, so that no other state gets its identity
            parent[label] = same

    dead: list[dict] = []
    for word, out in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        state = path[-1][0] if path else root
        for b in word[common:]:
            state[b] = new = {}
            path.append((new, b))
            state = new
        finals[id(state)] = True
        last = word
        ids += out
        starts.append(len(ids))
    settle(0)
    order: list[dict] = []
    at: dict[int, int] = {}
    stack = [root]
    while stack:
        s = stack.pop()
        if id(s) in at:
            continue
        at[id(s)] = len(order)
        order.append(s)
        stack.extend(s.values())
    below: dict[int, int] = {}
    stack = [(root, False)]
    while stack:  # children first
        s, done = stack.pop()
        if done:
            below[id(s)] = int(finals.get(id(s), False)) + sum(below[id(x)] for x in s.values())
        elif id(s) not in below:
            stack.append((s, True))
            stack.extend((x, False) for x in s.values())
    first, final, labels, targets, skips = [0], [], [], [], []
    for s in order:
        before = int(finals.get(id(s), False))
        final.append(before)
        for b, x in s.items():
            labels.append(b)
            targets.append(at[id(x)])
            skips.append(before)
            before += below[id(x)]
        first.append(len(labels))
    arrays = [np.array(x, dtype="<u4") for x in (first, final, labels, targets, skips, starts, ids)]
    head = _HEAD.pack(len(order), len(labels), len(starts) - 1, len(ids), len(dead))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Lookups in compiled bytes, which are mapped into memory."""

    def __init__(self, data: bytes):
        if hasattr(os, "memfd_create"):
            fd = os.memfd_create("lexicon")
            with os.fdopen(fd, "wb", closefd=False) as f:
                f.write(data)
            self._map = mmap.mmap(fd, len(data), access=mmap.ACCESS_READ)
            os.close(fd)
        else:
            self._map = mmap.mmap(-1, len(data))
            self._map.write(data)
        self.n_states, self.n_edges, self.n_words, n_ids, self.n_merged = _HEAD.unpack_from(self._map)
        at = _HEAD.size
        parts = []
        for n in (self.n_states + 1, self.n_states, self.n_edges, self.n_edges, self.n_edges, self.n_words + 1, n_ids):
            parts.append(np.frombuffer(self._map, dtype="<u4", count=n, offset=at))
            at += 4 * n
        first, self._final, label, self._target, self._skip, self._start, self._ids = parts
        # An edge's state and label as one number; edges are in the order of these.
        self._edge = np.repeat(np.arange(self.n_states, dtype=np.int64) << 8, np.diff(first.astype(np.int64))) | label

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is not in the lexicon; all words take a step at a time."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start, text = np.cumsum(size) - size, np.frombuffer(b"".join(words), dtype=np.uint8)
        state, rank, out = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
        open_, step = np.arange(len(words)), 0
        while len(open_):
            ended = size[open_] == step
            done = open_[ended]
            out[done] = np.where(self._final[state[done]] > 0, rank[done], -1)
            open_ = open_[~ended]
            key = state[open_] << 8 | text[start[open_] + step]
            at = np.minimum(np.searchsorted(self._edge, key), max(0, self.n_edges - 1))
            hit = self._edge[at] == key if self.n_edges else np.zeros(len(open_), dtype=bool)
            open_, at = open_[hit], at[hit]
            rank[open_] += self._skip[at]
            state[open_] = self._target[at]
            step += 1
        return out

    def ids(self, rank: int) -> bytes:
        """The ids of the word of a rank as little-endian unsigned 32-bit integers."""
        return self._ids[self._start[rank] : self._start[rank + 1]].tobytes()

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word, or None."""
        rank = int(self.find([word])[0])
        return None if rank < 0 else self.ids(rank)
