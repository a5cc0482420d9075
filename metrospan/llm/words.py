"""Words, word hashes and n-gram hashes of UTF-8 buffers as NumPy arrays."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(5)
RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = RAW.copy()
LOWER[65:91] = RAW[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = RAW, chunk: int = 1 << 20) -> np.ndarray:
    """Hash of each span ``data[start:end]``; spans are sorted and disjoint.
    Works in chunks of whole spans, so that memory stays bounded for long texts."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        up, down = _power(max(b - a + 1, chunk + 1))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions) and row of every run of bytes outside the gaps."""
    first, last = int(offsets[0]), int(offsets[-1])
    inside = ~(BLANK[data[first:last]] if gap is None else gap)
    edge = np.zeros(last - first + 1, bool)
    edge[offsets[(offsets >= first) & (offsets <= last)] - first] = True
    before = np.zeros(last - first, bool)
    before[1:] = inside[:-1]
    after = np.zeros(last - first, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1])) + first
    ends = np.flatnonzero(inside & (~after | edge[1:])) + first + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words of one row, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _U(_BASE) + hashes[k: k + n]
    at = np.flatnonzero(rows[:n] == rows[size - 1:])
    return mix(total[at]), at


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
