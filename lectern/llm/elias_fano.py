"""Elias-Fano codes of non-decreasing sequences, in numpy.

A value's low bits are packed; its high part is a run-length in unary. ``select``
finds a value's one in the unary bits from a sampled position and a popcount
scan, so no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxII")  # values, base, low bits, high bytes, samples


class EliasFano:
    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """``values``: non-negative, non-decreasing."""
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        base = int(v[0])
        v = v - np.uint64(base)
        span = int(v[-1])
        low_bits = max(0, (span // n).bit_length() - 1)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, base, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.base, self.low_bits, len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """The code that starts at ``at``, and where it ends."""
        n, base, low_bits, n_high, n_samples = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        n_low = (n * low_bits + 7) // 8
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, base, low_bits, low, high, samples), at + n_low + n_high + 4 * n_samples

    def select(self, i: int) -> int:
        """The value at index ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left = i % SAMPLE
        at = int(self.samples[i // SAMPLE])
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)  # ones before the sample are cleared
        while left >= (c := word.bit_count()):
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        return self.base + ((one - i) << self.low_bits | self._low(i))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        last = first + self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return chunk >> (first % 8) & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out + self.base
