"""Vectorised 64-bit hashes of byte windows and words in numpy (polynomial prefix sums modulo 2**64, then mixed)."""

from __future__ import annotations

import numpy as np

from .shared import worker_cache

BASE = np.uint64(0x9E3779B97F4A7C15)
OTHER_BASE = np.uint64(0xD6E8FEB86659FD93)
_WORD = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = worker_cache({})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of an ordered pair of names."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + np.uint64(1))


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        ones = np.ones(size, np.uint64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = base, inverse
        have = _POWERS[int(base)] = np.cumprod(up), np.cumprod(down)
    return have[0][:n], have[1][:n]


def byte_table(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64((seed * 2 + 1) & _WORD)) | np.uint64(1)


_TABLES = {int(BASE): byte_table(1), int(OTHER_BASE): byte_table(77)}


def prefix(data: np.ndarray, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums with a leading 0, inverse powers): the hash of data[s:e] is (p[e]-p[s]) * down[s]."""
    up, down = _powers(len(data) + 1, base)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[int(base)][data] * up[:len(data)], out=p[1:])
    return p, down


def windows(data: np.ndarray, size: int, base: np.uint64 = BASE) -> np.ndarray:
    """Mixed hash of every window of ``size`` bytes."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    p, down = prefix(data, base)
    n = len(data) - size + 1
    return mix((p[size:] - p[:n]) * down[:n])


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Mixed hash of each data[start:end], its length included."""
    p, down = prefix(data, base)
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of all words of the rows' texts; a word never crosses a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    bounds = offsets[:-1][np.diff(offsets) > 0]
    first[bounds] = True  # the first byte of each row
    starts_mask = inside.copy()
    starts_mask[1:] &= ~inside[:-1] | first[1:n]
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row its distinct shingles of ``size`` words as sorted 64-bit hashes, A-Z lower-cased; with fewer words
    the whole sequence as one shingle, without words none."""
    low = LOWER[data]
    starts, ends, rows = words(low, offsets)
    h = spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    per_row = np.searchsorted(rows, np.arange(len(offsets)))
    full = np.zeros(0, np.uint64)
    if len(h) >= size:
        full = h[:len(h) - size + 1].copy()
        for k in range(1, size):
            full = join(full, h[k:len(h) - size + 1 + k])
    out = []
    for a, b in zip(per_row[:-1], per_row[1:], strict=True):
        if b - a >= size:
            s = np.sort(full[a:b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            one = h[a:a + 1].copy()
            for k in range(a + 1, b):
                one = join(one, h[k:k + 1])
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(full[:0])
    return out
