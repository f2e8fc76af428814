"""Elias-Fano coding of ascending integers, with select and rank.

A value is cut into ``low`` bits, stored packed, and the rest, stored as a unary bitmap
in which the i-th one stands at ``(value >> low) + i``. About ``2 + log2(u / n)`` bits
hold a value below u. The place of every 256th one is stored with the code in 32 bits, an
eighth of a bit for each value; a list has fewer than 2^30 values, so no place needs more.
Reading opens views of the bytes as they are: select goes to a stored place and counts
ones from there, byte by byte through a table of 256 counts; nothing is unpacked as a whole.
"""

from __future__ import annotations

import struct

import numpy as np

STEP, BLOCK = 256, 65_536
#: Values of a list, at most.
MOST = 1 << 30
HEAD = struct.Struct("<QQBQQ")  # n, largest, low bits, bytes of low, bytes of high
#: Ones in a byte.
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    def __init__(self, n: int, largest: int, low: int, low_bits: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.largest, self.low, self.low_bits, self.high, self.samples = n, largest, low, low_bits, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        """From ascending values of zero or more; equal ones may follow each other."""
        v = np.asarray(values, np.uint64)
        if not len(v):
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if np.any(v[1:] < v[:-1]):
            raise ValueError("values must ascend")
        if len(v) >= MOST:
            raise ValueError(f"a list has fewer than {MOST} values")
        n, largest = len(v), int(v[-1])
        low = max(0, ((largest + 1) // n).bit_length() - 1)
        shifts = np.arange(low, dtype=np.uint64)
        packed = [np.packbits(((v[i : i + BLOCK, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little") for i in range(0, n, BLOCK)] if low else []
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, largest, low, np.concatenate(packed) if packed else np.zeros(0, np.uint8), np.packbits(bits, bitorder="little"), at[::STEP].astype(np.uint32))

    def nbytes(self) -> int:
        """Bytes that an opened list holds."""
        return self.low_bits.nbytes + self.high.nbytes + self.samples.nbytes

    def lows(self, a: int, b: int) -> np.ndarray:
        """Low parts of values a to b."""
        if not self.low:
            return np.zeros(b - a, np.uint64)
        first = a * self.low // 8
        bits = np.unpackbits(self.low_bits[first : (b * self.low + 7) // 8], bitorder="little")
        bits = bits[a * self.low - first * 8 :][: (b - a) * self.low].reshape(b - a, self.low)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, from zero; reads a few hundred bits."""
        return int(self.slice(i, i + 1)[0])

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b, self.n))
        if a == b:
            return np.zeros(0, np.uint64)
        k = a // STEP
        at = int(self.samples[k])
        # Ones before place ``a``, counted from the sampled one; its byte has earlier ones.
        byte, ones_before = at // 8, k * STEP - int(ONES[self.high[at // 8] & ((1 << at % 8) - 1)])
        found, seen = [], ones_before
        while seen < b:
            piece = self.high[byte : byte + 4096]
            counts = np.cumsum(ONES[piece], dtype=np.int64)
            # Only bytes with a wanted one are unpacked.
            first, last = int(np.searchsorted(counts, a - seen, "right")), int(np.searchsorted(counts, b - seen, "left")) + 1
            if first < len(piece):
                here = np.flatnonzero(np.unpackbits(piece[first:last], bitorder="little")) + (byte + first) * 8
                skipped = seen + (int(counts[first - 1]) if first else 0)
                found.append(here[max(0, a - skipped) : max(0, b - skipped)])
            seen, byte = seen + int(counts[-1]), byte + len(piece)
        ones = np.concatenate(found)
        return (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low) | self.lows(a, b)

    def rank(self, value: int) -> int:
        """How many values are less than ``value``: a bisection over select."""
        a, b = 0, self.n
        while a < b:
            middle = (a + b) // 2
            a, b = (middle + 1, b) if self.select(middle) < value else (a, middle)
        return a

    def __len__(self) -> int:
        return self.n

    def to_bytes(self) -> bytes:
        return HEAD.pack(self.n, self.largest, self.low, len(self.low_bits), len(self.high)) + self.low_bits.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, largest, low, a, b = HEAD.unpack_from(data)
        at = HEAD.size
        return cls(n, largest, low, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", -(-n // STEP), at + a + b))
