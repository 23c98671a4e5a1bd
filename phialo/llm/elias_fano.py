"""Elias-Fano lists of non-decreasing integers over memory-mapped bytes."""

from __future__ import annotations

import numpy as np

#: One-bits between two entries of the directory that finds a place in the high bits.
STRIDE = 512


def encode(values: np.ndarray) -> bytes:
    """Low bits packed, high bits in unary, and the place of every STRIDE-th one-bit.

    Header: number of values, low bits of each, bytes of the low and of the high part.
    """
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max((top // n).bit_length() - 1, 0) if n else 0
    low = values & np.uint64((1 << low_bits) - 1)
    bits = (low[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]).astype(np.uint8) & np.uint8(1) if low_bits else np.zeros((n, 0), np.uint8)
    low_part = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
    high[ones] = 1
    high_part = np.packbits(high, bitorder="little").tobytes()
    header = np.array([n, low_bits, len(low_part), len(high_part)], np.int64).tobytes()
    return header + low_part + high_part + ones[::STRIDE].astype(np.int64).tobytes()


class EliasFano:
    """A list over bytes that may be a memory map; a range is decoded when it is asked for."""

    def __init__(self, data: np.ndarray):
        self.n, self.low_bits, low, high = (int(x) for x in data[:32].view(np.int64))
        self.low, self.high = data[32 : 32 + low], data[32 + low : 32 + low + high]
        at = 32 + low + high
        self.marks = data[at : at + 8 * -(-self.n // STRIDE)]
        self.size = at + len(self.marks)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Values with numbers ``start`` to ``stop`` (exclusive)."""
        count = stop - start
        if count <= 0:
            return np.zeros(0, np.uint64)
        marks = np.frombuffer(self.marks.tobytes(), np.int64)
        first = int(marks[start // STRIDE])
        end = int(marks[-(-stop // STRIDE)]) if -(-stop // STRIDE) < len(marks) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first // 8 : -(-(end + 1) // 8)], bitorder="little")
        ones = np.flatnonzero(bits[first % 8 :])[start % STRIDE : start % STRIDE + count] + first
        high = (ones - np.arange(start, stop)).astype(np.uint64)
        k = self.low_bits
        if not k:
            return high
        at = start * k
        raw = np.unpackbits(self.low[at // 8 : -(-(stop * k) // 8)], bitorder="little")[at % 8 : at % 8 + count * k]
        low = raw.reshape(count, k).astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64))
        return (high << np.uint64(k)) | low
