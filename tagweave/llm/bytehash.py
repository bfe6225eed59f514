"""Hashes of every stretch of a byte buffer, and the anchors that long
repeats must share.

``Rolling`` keeps prefix sums of T[byte] * B**i modulo 2**64 (T random, B odd),
so the hash of any stretch is one subtraction and one product with B**-i.

Every ``length``-byte window names one anchor: the place of its smallest
``gram``-byte hash (the leftmost one).  Equal windows name the same anchor at
the same offset, so windows that share an anchor are handled together: a *run*
is a maximal row of consecutive windows with one anchor."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_POS_BITS = 24


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return finalize(x)


def finalize(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Stretch hashes of buffers; ``size`` is the length first reserved."""

    def __init__(self, size: int, seed: int = 1):
        self.table = _splitmix(256, seed * 1_000_003)
        self.base = (int(_splitmix(1, seed * 7_919)[0]) | 1) & _MASK
        self._reserve(size)

    def _reserve(self, size: int) -> None:
        self.size = size
        self.powers, self.inverses = self._series(self.base), self._series(pow(self.base, -1, 1 << 64))

    def _series(self, base: int) -> np.ndarray:
        out = np.ones(self.size + 1, dtype=np.uint64)
        n, step = 1, base
        with np.errstate(over="ignore"):
            while n <= self.size:
                m = min(n, self.size + 1 - n)
                out[n:n + m] = out[:m] * np.uint64(step)
                step = step * step & _MASK
                n *= 2
        return out

    def load(self, data: np.ndarray) -> None:
        if len(data) > self.size:
            self._reserve(len(data))
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(self.table[data] * self.powers[:len(data)], out=self.prefix[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return finalize((self.prefix[end] - self.prefix[start]) * self.inverses[start])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


def runs(rolling: Rolling, data: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Runs of a buffer that holds several texts (``starts`` are their first
    bytes, with the buffer's length at the end): (first window, last window,
    anchor) of every run; no window crosses a text's end.  Loads ``rolling``."""
    n = len(data)
    rolling.load(data)
    if n < length:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    at = np.arange(n - gram + 1)
    h = rolling.stretch(at, at + gram)
    keyed = (h >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | at.astype(np.uint64)
    anchor = (sliding_min(keyed, length - gram + 1) & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    windows = n - length + 1
    ends = np.repeat(starts[1:], np.diff(starts))[:windows]
    valid = np.arange(windows) + length <= ends
    first = np.flatnonzero(valid & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]]))
    last = np.flatnonzero(valid & np.concatenate([(anchor[1:] != anchor[:-1]) | ~valid[1:], [True]]))
    return first, last, anchor[first]
