"""A wavelet matrix over numpy: bit planes with rank and select, built, queried and inverted in vector steps.

The byte form (``to_bytes``) is self-contained: a header (magic, length, planes), the number of zeros of each plane,
the planes as little-endian bits and the rank directory (ones before every eighth 64-bit word), each in one zstandard frame. A
loaded matrix answers from that directory and at most eight words; ``ones`` makes a finer one for many queries.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVM2"


class WaveletMatrix:
    def __init__(self, n: int, zeros: np.ndarray, planes: np.ndarray, directory: np.ndarray | None = None):
        """planes: (bits, words) uint64, most significant bit first; directory: (bits, words / 8) ones before each eighth word."""
        self.n, self.bits, self.zeros, self.planes, self.directory = n, len(planes), zeros, planes, directory
        self._ones: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        values = np.ascontiguousarray(values, np.uint16 if bits <= 16 else np.uint32)
        n = len(values)
        words = n // 64 + 1
        planes, zeros = np.zeros((bits, words), np.uint64), np.zeros(bits, np.int64)
        one = values.dtype.type(1)
        for level in range(bits):
            bit = ((values >> values.dtype.type(bits - 1 - level)) & one).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes[level].view(np.uint8)[: len(packed)] = packed
            low = values[~bit]
            zeros[level] = len(low)
            values = np.concatenate([low, values[bit]])
        return cls(n, zeros, planes)

    def _plane(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").astype(bool)

    def decode(self) -> np.ndarray:
        """All values in order: each plane's stable partition is undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit, z = self._plane(level), int(self.zeros[level])
            before = np.empty(self.n, kind)
            before[~bit] = values[:z]
            before[bit] = values[z:] | kind(1 << (self.bits - 1 - level))
            values = before
        return values

    def ones(self) -> np.ndarray:
        if self._ones is None:
            self._ones = np.zeros(self.planes.shape, np.int64)
            np.cumsum(np.bitwise_count(self.planes[:, :-1]), axis=1, out=self._ones[:, 1:], dtype=np.int64)
        return self._ones

    def rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits of a plane."""
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        part = np.bitwise_count(self.planes[level][word] & ((np.uint64(1) << rest) - np.uint64(1)))
        if self._ones is None and self.directory is not None:
            full = self.directory[level][word >> 3] + part
            for k in range(7):
                at = (word & ~7) + k
                inside = at < word
                full = full + np.where(inside, np.bitwise_count(self.planes[level][np.where(inside, at, 0)]), 0)
            return full
        return self.ones()[level][word] + part

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            one = (self.planes[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            up = self.rank1(level, i)
            out = out << 1 | one
            i = np.where(one, self.zeros[level] + up, i - up)
        return out

    def locate(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """rank() of many (value, i) pairs given as arrays of one length."""
        value, hi = value.astype(np.int64), i.astype(np.int64)
        starts = self._starts()
        for level in range(self.bits):
            up = self.rank1(level, hi)
            one = (value >> (self.bits - 1 - level) & 1).astype(bool)
            hi = np.where(one, self.zeros[level] + up, hi - up)
        return hi - starts[value]

    def _starts(self) -> np.ndarray:
        """Where the block of each value begins below the last plane."""
        if not hasattr(self, "_first"):
            value = np.arange(1 << self.bits, dtype=np.int64)
            lo = np.zeros(len(value), np.int64)
            for level in range(self.bits):
                one = (value >> (self.bits - 1 - level) & 1).astype(bool)
                a = self.rank1(level, lo)
                lo = np.where(one, self.zeros[level] + a, lo - a)
            self._first = lo
        return self._first

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often value occurs among the first i entries; value and i broadcast."""
        value, hi = np.broadcast_arrays(np.atleast_1d(np.asarray(value, np.int64)), np.atleast_1d(np.asarray(i, np.int64)))
        lo, hi = np.zeros(len(hi), np.int64), hi.copy()
        for level in range(self.bits):
            one = (value >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo

    def count(self, value: int) -> int:
        return int(self.rank(value, self.n)[0])

    def select(self, value: int, k: int) -> int:
        """Position of occurrence k (from 0) of value, or -1."""
        lo, path = 0, []
        for level in range(self.bits):
            path.append(lo)
            a = int(self.rank1(level, np.array([lo]))[0])
            lo = int(self.zeros[level]) + a if value >> (self.bits - 1 - level) & 1 else lo - a
        if k < 0 or k >= self.count(value):
            return -1
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            z = int(self.zeros[level])
            at = self._select(level, at - z, True) if value >> (self.bits - 1 - level) & 1 else self._select(level, at, False)
        return at

    def _select(self, level: int, k: int, one: bool) -> int:
        before = self.ones()[level] if one else np.arange(self.planes.shape[1]) * 64 - self.ones()[level]
        word = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][word : word + 1].view(np.uint8), bitorder="little").astype(bool)
        return word * 64 + int(np.flatnonzero(bits == one)[k - int(before[word])])

    def positions(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def to_bytes(self) -> bytes:
        z = zstandard.ZstdCompressor(level=1)
        planes = z.compress(self.planes.astype("<u8").tobytes())
        directory = z.compress(np.ascontiguousarray(self.ones()[:, ::8]).astype("<u4").tobytes())
        return MAGIC + struct.pack("<QIQ", self.n, self.bits, len(planes)) + self.zeros.astype("<i8").tobytes() + planes + directory

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        n, bits, size = struct.unpack_from("<QIQ", data, 4)
        at, z = 24 + 8 * bits, zstandard.ZstdDecompressor()
        planes = np.frombuffer(z.decompress(data[at : at + size]), "<u8").reshape(bits, -1)
        directory = np.frombuffer(z.decompress(data[at + size :]), "<u4").reshape(bits, -1).astype(np.int64)
        return cls(n, np.frombuffer(data, "<i8", bits, 24), planes, directory)
