"""Words of Arrow text columns as 64-bit hashes, computed on whole buffers.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D.  No byte of a
multi-byte UTF-8 character is one of these, so bytes and code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  #: bytes hashed at a time
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)
_FOLDED = _BYTE[LOWER]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    _, offsets = buffers(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    edge = offsets[1:]
    last[edge[edge > 0] - 1] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each row's first.

    ``fold`` lower-cases A-Z first.  Memory beside the result is a few times
    ``BLOCK``, however long a row is; only a word longer than that needs more.
    """
    starts, ends = word_spans(data, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    values = _FOLDED if fold else _BYTE
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        size = int(ends[to - 1]) - base
        power, inverse = _powers(max(BLOCK, 1 << (size - 1).bit_length()))
        total = np.empty(size + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[data[base : base + size]] * power[:size], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out, np.searchsorted(starts, offsets, "left")


_STEP = mix(np.arange(64, dtype=np.uint64), 11) | np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words.

    Fewer words make one window of all of them; no words make none.
    """
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    h = words[: n - k + 1] * _STEP[0]
    for j in range(1, k):
        h = h + words[j : n - k + 1 + j] * _STEP[j]
    return np.unique(mix(h, k))
