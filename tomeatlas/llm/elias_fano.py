"""Elias-Fano coded monotone sequences over numpy arrays, which may be memory-mapped."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` (from 0) of each word."""
    word, rank, at = word.copy(), rank.astype(np.int64), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = rank >= below
        rank -= np.where(up, below, 0)
        word = np.where(up, word >> np.uint64(width), word)
        at += np.where(up, width, 0)
    return at


class EliasFano:
    """A sorted sequence: low bits packed, high parts in unary with a directory of ones per word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        step = 1 << 16  # a multiple of 8 entries ends on a byte
        for i in range(0, n if bits else 0, step):
            part = values[i : i + step]
            flat = ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & _ONE).astype(np.uint8)
            packed = np.packbits(flat.ravel(), bitorder="little")
            low[i * bits // 8 : i * bits // 8 + len(packed)] = packed
        size = (universe >> bits) + n + 2
        flags = np.zeros((size + 63) // 64 * 64, bool)
        flags[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return cls(n, bits, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        eight = np.ndarray(shape=(len(self.low) - 7,), dtype="<u8", buffer=self.low, strides=(1,))
        return (eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}


class Packed:
    """Whole numbers in as few whole bytes each as the largest needs."""

    def __init__(self, width: int, raw: np.ndarray):
        self.width, self.raw = width, raw
        self.mask = np.uint64((1 << 8 * width) - 1)
        self.eight = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))

    @classmethod
    def of(cls, values: np.ndarray, largest: int) -> Packed:
        width = max(1, (int(largest).bit_length() + 7) // 8)
        flat = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].ravel()
        return cls(width, np.concatenate([flat, np.zeros(8, np.uint8)]))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.eight[i * self.width] & self.mask).astype(np.int64)

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """First place from ``lo`` on whose number is not less than ``x``, or ``hi``; numbers ascend between the two."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self[mid] < x[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo
