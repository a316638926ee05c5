"""Elias-Fano code of a non-decreasing sequence, with select.

n values below u take about n * (2 + log2(u / n)) bits: the low ``l`` bits of each value
lie side by side, the high parts are a bitmap with a one at (value >> l) + index. Every
``STEP``-th one's place is kept as a 32-bit number, so ``select`` reads one stretch of the bitmap.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
HEAD = struct.Struct("<QQBxxxIII")


class EliasFano:
    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.places = n, base, low_bits, low, high, places

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """``values``: int64, non-decreasing, of any sign."""
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        base = int(values[0]) if n else 0
        v = values.astype(np.uint64) - np.uint64(base & (2**64 - 1))
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bitmap[ones] = 1
        return cls(n, base, low_bits, low, np.packbits(bitmap, bitorder="little"), ones[::STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = HEAD.pack(self.n, self.base & (2**64 - 1), self.low_bits, len(self.low), len(self.high), len(self.places))
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, base, low_bits, a, b, c = HEAD.unpack_from(data)
        at = HEAD.size
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        places = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, base - 2**64 if base >= 2**63 else base, low_bits, low, high, places)

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= ((int(self.low[bit >> 3]) >> (bit & 7)) & 1) << k
        return value

    def select(self, i: int) -> int:
        """The i-th value, from the nearest kept place before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.places[i // STEP])
        end = int(self.places[i // STEP + 1]) + 1 if i // STEP + 1 < len(self.places) else len(self.high) * 8
        bits = np.unpackbits(self.high[start >> 3 : (end + 7) >> 3], bitorder="little")
        place = int(np.flatnonzero(bits[start & 7 :])[i % STEP]) + start
        return (((place - i) << self.low_bits) | self._low(i)) + self.base

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        v = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            v |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (v + np.uint64(self.base & (2**64 - 1))).astype(np.int64)
