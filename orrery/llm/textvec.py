"""Words and word shingles of whole Arrow text columns as NumPy arrays of 64-bit hashes.

No Python string is made: a word is a run of bytes between separators, its hash a
polynomial in the bytes modulo 2**64 taken from running sums, then mixed. Work goes
in pieces of about ``PIECE`` bytes cut at word ends, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
#: Text bytes that operators take at a time; a longer document is taken alone.
GROUP = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Factors of the words of a shingle, by place.
PLACE = _rng.integers(1, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits.
NON_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, PIECE + (1 << 16)) - 1, base, np.uint64)]), dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray, size: int = GROUP, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) with about ``size`` bytes together, of at most ``rows`` rows."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, i + rows) if rows else j
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte start of each word, hash of each lower-cased word, first word of each row, n+1 entries)."""
    starts, hashes = [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:  # back to a word end; a longer word makes the piece longer
            gap = np.flatnonzero(separators[data[lo:hi]])
            cut = off[np.searchsorted(off, hi, "right") - 1]
            back = max(lo + int(gap[-1]) + 1 if len(gap) else lo, int(cut))
            if back > lo:
                hi = back
                break
            hi = min(n, hi + PIECE)
        piece = data[lo:hi]
        word = ~separators[piece]
        first = np.searchsorted(off, lo, "left")
        bounds = off[first : np.searchsorted(off, hi, "left")] - lo
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        at = bounds[(bounds > 0) & (bounds < len(piece))]
        begins[at] = word[at]
        ends[at - 1] = word[at - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[LOWER[piece]] * _power(_P, len(piece)), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * _power(_P_INV, len(piece))[s] + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return start, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(start, off, "left")


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 entries are missing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * PLACE[0]
    for j in range(1, k):
        out = out + h[j : n + j] * PLACE[j]
    return mix(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one row's words; fewer than k words count as one shingle."""
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < k:
        return mix((h * PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    return np.unique(shingles(h, k))
