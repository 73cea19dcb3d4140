"""Texts of an Arrow batch as one array of bytes, so that whole batches are worked on at once.

A batch is handled in runs of whole documents (``runs``), so that the arrays stay small
whatever the batch holds; a single document may be larger than the wished size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
RUN_BYTES = 1 << 20
#: Bytes up to which a piece is named by a sum of powers.
SUMMED = 32

_MULT = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each starts (one more entry ends the last)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive documents [i, j) of about ``size`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, everything else as it is."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def owners(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The document of each start."""
    return np.searchsorted(offsets, starts, "right") - 1


def _doc_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = np.zeros(n + 1, bool)
    first[at] = True
    first[n] = True
    return first


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, ``[^\\x20\\x09-\\x0D]+``, never across documents."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = (data != 32) & ((data - np.uint8(9)) > 4)
    first = _doc_starts(offsets, n)
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends


@lru_cache(1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, RUN_BYTES + (1 << 16))
        _powers[:] = []
        for base in (_MULT, pow(_MULT, -1, 2**64)):
            p = np.full(m, np.uint64(base))
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each piece of text; equal bytes have equal names, wherever they stand.

    Sums of powers modulo 2^64 are weak for long pieces, which are hashed one by one instead.
    """
    n = len(data)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_codes()[data] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h = finish(h + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > SUMMED)
    if len(long):
        whole = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return h


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces themselves, as binary values."""
    lens = ends - starts
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(starts - off[:-1], lens)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(data[at])])


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point in the sense of the tokenizers' split pattern."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start():m.end()] = kind
    return table


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character each byte belongs to."""
    table = _classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.zeros(len(data) + 3, np.uint8)
        wide[:len(data)] = data
        b0, b1, b2, b3 = (wide[lead + i].astype(np.int64) for i in range(4))
        two = ((b0 & 31) << 6) | (b1 & 63)
        three = ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63)
        four = ((b0 & 7) << 18) | ((b1 & 63) << 12) | ((b2 & 63) << 6) | (b3 & 63)
        code = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        own = table[code]
        for i, most in ((0, 0), (1, 0), (2, 0xE0), (3, 0xF0)):
            here = b0 >= most
            kind[lead[here] + i] = own[here]
    return kind


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the tokenizers' split pattern, which cover all bytes.

    The pattern cuts a text into runs of letters, numbers, other characters and white space.
    One blank before a run goes with it, the last white space before a run stands alone if it
    is no blank, and 's 't 're 've 'm 'll 'd are cut off where the apostrophe starts a match.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _byte_classes(data)
    first = _doc_starts(offsets, n)
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut |= first
    at = np.flatnonzero(cut[1:n] & ~first[1:n]) + 1
    at = at[kind[at - 1] == SPACE]
    last = at - 1
    for _ in range(2):  # white space has three bytes at most
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    cut[last] = True
    cut[at[data[last] == 32]] = False
    quote = np.flatnonzero((data == 39) & cut[:n])
    quote = quote[~first[quote + 1]]
    if len(quote):
        wide = np.zeros(n + 3, np.uint8)
        wide[:n] = data
        a, b = wide[quote + 1], wide[quote + 2]
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        inside = ~first[np.minimum(quote + 2, n)]
        long = inside & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
        for hit, size in ((short, 2), (long, 3)):
            cut[quote[hit] + 1] = False
            cut[quote[hit] + size] = True
    edges = np.flatnonzero(cut)
    return edges[:-1], edges[1:]
