"""Word shingles of many texts at once, as 64-bit hashes, with numpy over an Arrow batch's own bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are worked on together, but for longer single texts.
CHUNK = 1 << 19
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PLACES = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


@lru_cache(16)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(base: int, n: int) -> np.ndarray:
    """base**k modulo 2**64 for k < n."""
    return _powers(base, max(1 << 20, 1 << (n - 1).bit_length()))[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of stretches of whole texts of about CHUNK bytes."""
    data, at = text_buffers(column)
    k = 0
    while k < len(at) - 1:
        end = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, "right")) - 1)
        yield k, data[at[k] : at[end]], at[k : end + 1] - at[k]
        k = end


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingle hashes in order) of every text that has a word.

    Words lie between bytes 0x20 and 0x09-0x0D, A-Z lower-cased; a text of fewer than five words is one shingle.
    """
    for first, data, at in chunks(column):
        n = len(data)
        if not n:
            continue
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True  # no word reaches over two texts
        begins = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:n])))
        ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:n], [True]))) + 1
        if not len(begins):
            continue
        low = data.astype(np.uint64) + np.uint64(1)
        low[(data >= 65) & (data <= 90)] += np.uint64(32)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * powers(_BASE, n))))
        word = mixed((sums[ends] - sums[begins]) * powers(_INVERSE, n)[begins])
        bounds = np.searchsorted(begins, at)
        m = len(word)
        padded = np.concatenate((word, np.zeros(SHINGLE, np.uint64)))
        whole = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            whole += padded[k : k + m] * _PLACES[k]
        whole = mixed(whole)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b - a >= SHINGLE:
                yield first + i, np.unique(whole[a : b - SHINGLE + 1])
            elif b > a:
                short = (word[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield first + i, mixed(short + np.full(1, b - a, np.uint64) * np.uint64(0xA0761D6478BD642F))
