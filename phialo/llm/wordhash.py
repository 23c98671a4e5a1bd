"""64-bit hashes of all words and shingles of an Arrow text column, by array arithmetic.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z.  The hash of a word is a polynomial of
random byte values, taken from running sums; shingle hashes combine word hashes by place and
are mixed.  Everything is a function of the words alone, so it agrees between tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_rng = np.random.default_rng(20240501)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PLACES = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below ``n``; kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base & (2**64 - 1), np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and where each row's words start (rows + 1)."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    size = len(text)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    solid = ~_BLANK[text]
    edge = np.zeros(size + 1, dtype=bool)
    edge[bounds] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:size]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:size]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    power, inverse = _power(size)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_VALUE[text] * power, out=sums[1:])
    hashes = mix((sums[last + 1] - sums[first]) * inverse[first] + (last - first + 1).astype(np.uint64))
    return hashes, np.searchsorted(first, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats), and where each row's shingles start.

    A row with fewer words than ``size`` has its whole sequence as one; without words, none.
    """
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    whole = np.zeros(0, np.uint64)
    if len(hashes) >= size:
        whole = sum(hashes[k : len(hashes) - size + 1 + k] * PLACES[k] for k in range(size))
        whole = mix(whole + np.uint64(size))
    out = np.empty(out_bounds[-1], np.uint64)
    long = n >= size
    # positions of a long row's shingles are one run, both in the words and in the result
    shift = np.repeat((bounds[:-1] - out_bounds[:-1])[long], counts[long])
    into = np.arange(out_bounds[-1])[np.repeat(long, counts)] if len(counts) else np.zeros(0, np.int64)
    out[into] = whole[into + shift] if len(into) else whole[:0]
    for r in np.flatnonzero((n > 0) & (n < size)):
        row = hashes[bounds[r] : bounds[r + 1]]
        out[out_bounds[r]] = mix((row * PLACES[: len(row)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(row)))[0]
    return out, out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, without repeats, and where each row starts."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.searchsorted(r[new], np.arange(len(bounds)))
