"""Token ids of distinct words, remembered by a worker across the batches it sees."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from leafgraph.llm import text_arrays as A

#: Words remembered by one worker; beyond it the memory starts anew. It bounds memory, not results.
REMEMBERED = 2_000_000
#: Bytes of remembered words likewise.
REMEMBERED_BYTES = 128 << 20


def _same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether pieces of equal length are equal."""
    if not len(length):
        return np.zeros(0, bool)
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    equal = a[np.repeat(a_start, length) + within] == b[np.repeat(b_start, length) + within]
    return np.bincount(np.repeat(np.arange(len(length)), length), ~equal, len(length)) == 0


class _Grown:
    """An array that is appended to."""

    def __init__(self, kind):
        self.values, self.size = np.zeros(1 << 16, kind), 0

    def append(self, more: np.ndarray) -> int:
        """Where the new values start."""
        need = self.size + len(more)
        if need > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(need, 2 * len(self.values)) - len(self.values), self.values.dtype)])
        at, self.size = self.size, need
        self.values[at:need] = more
        return at


class WordIds:
    """Looks up words; asks ``encode`` (binary words -> lengths, flat ids) for new ones.

    Words are found by a 64-bit name and their bytes are compared. A word whose name belongs
    to another one is encoded whenever it is met.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.ids, self.text = _Grown(np.int32), _Grown(np.uint8)
        #: (name, start of the ids, number of ids, start of the bytes, number of bytes), by name.
        self.levels: list[tuple[np.ndarray, ...]] = []

    def _add(self, level: tuple[np.ndarray, ...]) -> None:
        """Sorted levels, each less than half of the one before, so that words move seldom."""
        self.levels.append(level)
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            a, b = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b)]
            order = np.argsort(both[0])
            self.levels.append(tuple(x[order] for x in both))

    def _find(self, names: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of the ids, -1 where a word is new; and whether its name is known."""
        start, length = np.full(len(names), -1, np.int64), np.zeros(len(names), np.int64)
        taken = np.zeros(len(names), bool)
        for key, s, n, t, m in self.levels:
            at = np.minimum(np.searchsorted(key, names), len(key) - 1)
            hit = np.flatnonzero(key[at] == names)
            taken[hit] = True
            hit = hit[m[at[hit]] == size[hit]]
            hit = hit[_same_bytes(data, begin[hit], self.text.values, t[at[hit]], size[hit])]
            start[hit], length[hit] = s[at[hit]], n[at[hit]]
        return start, length, taken

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Of each word: where its ids start, and their number; for ``gather``."""
        if sum(len(x[0]) for x in self.levels) > REMEMBERED or self.text.size > REMEMBERED_BYTES:
            self.clear()
        coded = A.pieces(data, starts, ends).dictionary_encode()
        words, inverse = coded.dictionary, coded.indices.to_numpy()
        off = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1] if len(words) else np.zeros(1, np.int64)
        own = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        size = np.diff(off)
        names = A.names(own[:off[-1]], off[:-1], off[1:])
        start, length, taken = self._find(names, own, off[:-1], size)
        new = np.flatnonzero(start < 0)
        if len(new):
            some = words.take(pa.array(new))
            n, ids = self.encode(some)
            at = self.ids.append(ids) + np.cumsum(n) - n
            start[new], length[new] = at, n
            text = np.frombuffer(some.buffers()[2], np.uint8)[:int(size[new].sum())]
            begin = self.text.append(text) + np.cumsum(size[new]) - size[new]
            key, first = np.unique(names[new], return_index=True)
            free = ~taken[new[first]]
            key, first = key[free], first[free]
            if len(key):
                self._add((key, *(x[first].astype(np.int32) for x in (at, n, begin, size[new]))))
        return start[inverse], length[inverse]

    def gather(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ids of the words, one after another."""
        first = np.cumsum(length) - length
        return self.ids.values[np.arange(int(length.sum())) + np.repeat(start - first, length)]


def per_document(values: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over the words of each document."""
    edge = np.searchsorted(starts, offsets)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edge[1:]] - total[edge[:-1]]
