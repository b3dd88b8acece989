"""Vectorised hashes of parts of a byte string: polynomial prefix sums modulo 2^64, then a finalizer."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, dtype=np.uint64), INVERSE: np.ones(1, dtype=np.uint64)}
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        size = max(n, 2 * len(have), 1 << 14)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of any part of data by its bounds."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, dtype=np.uint8)
        self.bytes, self.n = b, len(b)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)), out=self.sums[1:])
        self.back = powers(INVERSE, len(b) + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))

    def rolling(self, k: int) -> np.ndarray:
        n = self.n - k + 1
        return mixed((self.sums[k:] - self.sums[:n]) * self.back[:n])


def word_hashes(data: bytes) -> np.ndarray:
    p = Prefix(data)
    blank = np.ones(p.n + 2, dtype=bool)
    blank[1:-1] = SPACE[p.bytes]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return p.of(edge[0::2], edge[1::2])


def shingles(data: bytes, size: int = 5) -> np.ndarray:
    """The sorted set of hashes of all runs of `size` words; a shorter text with words is one run."""
    w = word_hashes(data)
    n = len(w)
    if not n:
        return w
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + w[j : n - size + 1 + j]
    return np.unique(mixed(out + np.uint64(size)))


def window_extreme(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each full window of w: running values from both ends of blocks of w."""
    n = len(x)
    pad = -n % w
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if f is np.minimum else np.uint64(0)
    y = np.concatenate((x, np.full(pad, fill))).reshape(-1, w)
    ahead = f.accumulate(y, axis=1).ravel()
    behind = f.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - w + 1], ahead[w - 1 : n])
