"""Words, word hashes and word shingles of text columns, on flat numpy arrays.

Words are maximal runs of letters and digits in lower case; each Han character
is a word of its own.  Texts are taken in their reading form first.
"""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import arrowtext as at
from .reading import normalise

_MAX = 0x110000
_HAN = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32400))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.zeros(_MAX, np.uint8)  # 0 outside words, 1 in words, 2 a word of its own
    low = np.arange(_MAX, dtype=np.uint32)
    for c in range(0x32400):
        ch = chr(c)
        if ch.isalnum():
            kind[c] = 1
        s = ch.lower()
        if len(s) == 1:
            low[c] = ord(s)
    for lo, hi in _HAN:
        kind[lo:hi] = 2
    low[0x0130] = ord("i")
    code = mix(np.arange(_MAX, dtype=np.uint64))
    return kind, low, code[low]


def word_spans(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (code points) and row of each word."""
    kind = _tables()[0][cps]
    inside = kind > 0
    if not inside.any():
        z = np.empty(0, np.int64)
        return z, z, z
    edge = np.ones(len(cps), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge[off[:-1][off[:-1] < len(cps)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(cps))
    ok = inside[starts]
    starts, ends = starts[ok], ends[ok]
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word in lower case: mixed polynomial of its characters."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    idx = np.repeat(starts, lens) + pos
    power = np.ones(int(lens.max()), np.uint64)
    if len(power) > 1:
        power[1:] = _U(0x9E3779B97F4A7C15 | 1)
        power = np.cumprod(power, dtype=np.uint64)
    terms = _tables()[2][cps[idx]] * power[pos]
    return mix(np.add.reduceat(terms, np.cumsum(lens) - lens) + lens.astype(np.uint64))


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, end to end, and the offsets of each row's words; reading form."""
    cps, off = normalise(*at.to_codepoints(col))
    s, e, row = word_spans(cps, off)
    return word_hashes(cps, s, e), np.searchsorted(row, np.arange(len(off)))


def shingle_hashes(h: np.ndarray, woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words, and their offsets by row."""
    counts = np.maximum(np.diff(woff) - n + 1, 0)
    off = np.zeros(len(woff), np.int64)
    np.cumsum(counts, out=off[1:])
    if not off[-1]:
        return np.empty(0, np.uint64), off
    first = np.repeat(woff[:-1] - off[:-1], counts) + np.arange(off[-1])
    acc = np.zeros(len(first), np.uint64)
    for k in range(n):
        acc = mix(acc * _U(0xD6E8FEB86659FD93) + h[first + k])
    return acc, off


#: Bits of a shingle's hash that are kept: with the row above them they sort as one number.
SHINGLE_BITS = 48


def distinct_by_row(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, of SHINGLE_BITS bits."""
    n, step, low = len(off) - 1, 1 << (64 - SHINGLE_BITS), _U((1 << SHINGLE_BITS) - 1)
    parts, counts = [np.empty(0, np.uint64)], []
    for a in range(0, n, step):
        z = min(n, a + step)
        row = np.repeat(np.arange(z - a, dtype=np.uint64), np.diff(off[a : z + 1]))
        x = np.sort((row << _U(SHINGLE_BITS)) | (h[off[a] : off[z]] & low))
        x = x[np.append(True, x[1:] != x[:-1])[: len(x)]]
        counts.append(np.bincount((x >> _U(SHINGLE_BITS)).astype(np.int64), minlength=z - a))
        parts.append(x & low)
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]), out=out[1:])
    return np.concatenate(parts), out


def shingle_sets(col: pa.Array, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of a text column, and their offsets."""
    return distinct_by_row(*shingle_hashes(*words_of(col), n))


def minhashes(h: np.ndarray, off: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(rows, k) uint32 minimum hashes; rows without shingles hold the largest value."""
    n = len(off) - 1
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(off[1:] > off[:-1])
    if not len(full):
        return out
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**31, k, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, k, np.int64).astype(np.uint32)
    base = (mix(h) >> _U(32)).astype(np.uint32)
    x, y, at = np.empty_like(base), np.empty_like(base), off[:-1][full]
    for j in range(k):  # 32-bit steps, in place
        np.add(base, add[j], out=x)
        np.multiply(x, mul[j], out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        np.right_shift(x, np.uint32(12), out=y)
        np.bitwise_xor(x, y, out=x)
        out[full, j] = np.minimum.reduceat(x, at)
    return out
