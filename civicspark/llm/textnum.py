"""Array kernels over whole Arrow batches of texts: words, hashes, shingles.

A word's hash is a 64-bit polynomial of its bytes, mixed. Separators are
ASCII bytes, so UTF-8 text is worked on as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array, text_of_null: str = "") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets (null: no bytes)."""
    column = column.fill_null(text_of_null).cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes together, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


class Hasher:
    """Word hashes. ``separators``: byte values that part words; A-Z count
    as a-z."""

    def __init__(self, separators):
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        self.lower = table
        self.parts = np.zeros(256, bool)
        self.parts[list(separators)] = True
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.base, self.inverse = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
        self.power = self.down = np.zeros(0, np.uint64)

    def grow(self, n: int):
        if len(self.power) < n:
            for name, b in (("power", self.base), ("down", self.inverse)):
                x = np.full(n, b & M64, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words on end, and the number of words up to the
        start of each row (n + 1 numbers). Row ends part words too."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        self.grow(n)
        inside = ~self.parts[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < n]
        first[edge] = inside[edge]
        start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        end = np.flatnonzero(last) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(inside, self.value[self.lower[raw]] * self.power[:n], np.uint64(0)), out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)), np.searchsorted(start, offsets)


def shingles(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's ``size``-word windows in order (a row of fewer
    words, but not none: its whole sequence), and their row offsets."""
    n = len(words)
    count = np.diff(rows)
    full = np.maximum(count - size + 1, 0)
    part = (count > 0) & (count < size)
    out_rows = np.concatenate([[0], np.cumsum(np.where(part, 1, full))])
    h = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size if len(h) else 0):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(h)])
    begin = np.repeat(rows[:-1], full) + (np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full))
    out = np.zeros(int(out_rows[-1]), np.uint64)
    whole = np.repeat(~part, np.where(part, 1, full))
    out[whole] = h[begin]
    for r in np.flatnonzero(part):
        x = np.zeros(1, np.uint64)
        for k in range(rows[r], rows[r + 1]):
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + words[k:k + 1])
        out[out_rows[r]:out_rows[r] + 1] = x + np.uint64(count[r])
    return out, out_rows


def row_sets(hashes: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's distinct hashes, sorted."""
    for a, b in zip(rows[:-1], rows[1:]):
        x = np.sort(hashes[a:b])
        yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def digest(values: np.ndarray) -> bytes:
    """16 bytes of a sorted set of hashes."""
    n = np.uint64(len(values))
    a = mix(np.array([mix(values).sum(dtype=np.uint64) + n], np.uint64))
    b = mix(np.array([mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) ^ n], np.uint64))
    return a.tobytes() + b.tobytes()
