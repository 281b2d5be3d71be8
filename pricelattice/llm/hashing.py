"""Words of many texts as 64-bit digests, worked out over whole byte buffers instead of word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are taken together up to this many bytes, so that the arrays stay in the processor's cache.
CHUNK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def stir(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        with np.errstate(over="ignore"):
            _powers[which] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n * 5 // 4, base, np.uint64))])
    return _powers[which][:n]


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest and first byte of each word of the texts that begin at ``starts`` in ``data`` (bytes), A-Z in lower case.

    A word's digest is a polynomial in its bytes modulo 2^64, read off one running sum over the buffer, then stirred."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = ~GAPS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    with np.errstate(over="ignore"):
        sums = np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)))
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        return stir((sums[last] - before) * _power("down", _BACK, len(data))[first]), first


def word_codes(text: bytes) -> np.ndarray:
    return words(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of a string column: number of the first text, the bytes of all, and where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, data[offsets[at]:offsets[end]], offsets[at:end] - offsets[at]
        at = end
