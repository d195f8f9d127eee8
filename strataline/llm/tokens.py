"""Vectorised work on the bytes of many texts at once (NumPy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20   # bytes of text worked on at once; a longer text is worked on alone

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = _space.copy()   # white space and ASCII punctuation
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_byte = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", _inverse)):
            p = np.ones(size, np.uint64)
            p[1:] = base
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, nulls empty, and the offsets of its rows."""
    t = texts.cast(pa.large_string())
    if t.null_count:
        t = t.fill_null("")
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset:t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    data = t.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``size`` bytes, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _space, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash, row, first byte and end of each word of some rows; letters A-Z count as a-z.  offsets start at 0 of data;
    gaps says which bytes part words.  Then the hashes of the words' first bytes for each length in beginnings (that of
    the word where it is no longer)."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), e, e, e) + (np.zeros(0, np.uint64),) * len(beginnings)
    x = _lower[data]
    gap = gaps[x]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1] | edge[1:-1]
    last[:-1] &= gap[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte[x] * up[:n], out=total[1:])

    def hashed(stop):
        return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    return (hashed(end), np.searchsorted(offsets, start, "right") - 1, start, end, *[hashed(np.minimum(end, start + k)) for k in beginnings])
