"""Elias-Fano sequences in flat arrays: low bits packed, high bits in unary, found by select over a zero directory."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other, in 64-bit words with one spare."""
    out = []
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        out.append(np.packbits(((part[:, None] >> np.arange(width, dtype=_U)) & _U(1)).astype(np.uint8).ravel(), bitorder="little"))
    data = np.concatenate(out) if out and width else np.empty(0, np.uint8)
    words = np.zeros(len(data) // 8 + 2, dtype=_U)
    words.view(np.uint8)[: len(data)] = data
    return words


def unpack(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    """The numbers at the places ``i`` of what ``pack`` gave."""
    bit = i * width
    word, shift = bit >> 6, (bit & 63).astype(_U)
    return ((words[word] >> shift) | ((words[word + 1] << _U(1)) << (_U(63) - shift))) & _U((1 << width) - 1)


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a sorted sequence of 64-bit numbers (distinct ones, if they are to be found by value)."""
    n = len(values)
    last = int(values[-1]) if n else 0
    width = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
    high = (values >> _U(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
    bits[high + np.arange(n)] = 1
    bits[size:] = 1  # no zeros behind the last
    words = np.packbits(bits, bitorder="little").view(_U)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])[:-1]
    return {"low": pack(values & _U((1 << width) - 1), width), "high": words, "zeros": zeros.astype(np.uint32 if size < 2**32 else _U), "shape": np.array([n, width, int(high[-1]) if n else -1], dtype=np.int64)}


class EliasFano:
    """Search in arrays of ``encode``, which may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self.n, self.width, self.top = (int(x) for x in arrays["shape"])
        self.mask = _U((1 << self.width) - 1)
        self.ones = (np.arange(len(self.zeros), dtype=np.int64) << 6) - self.zeros.astype(np.int64)

    def lows(self, i: np.ndarray) -> np.ndarray:
        return unpack(self.low, self.width, i)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The number at each place ``i``: the one with number i in the high bits, found through the same directory."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        rest = i - self.ones[word]
        w, at = self.high[word], word << 6
        for half in (32, 16, 8, 4, 2, 1):
            part = w & _U((1 << half) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            go = rest >= ones
            rest = rest - np.where(go, ones, 0)
            w = np.where(go, w >> _U(half), part)
            at = at + np.where(go, half, 0)
        return ((at - i) << self.width) | self.lows(i).astype(np.int64)

    def upto(self, bucket: np.ndarray) -> np.ndarray:
        """Elements whose high part is at most ``bucket`` (in order, so that the directory is read in order)."""
        word = np.searchsorted(self.zeros, bucket, side="right") - 1
        rest = bucket - self.zeros[word].astype(np.int64)
        w, at = ~self.high[word], word << 6
        for half in (32, 16, 8, 4, 2, 1):
            part = w & _U((1 << half) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            go = rest >= ones
            rest -= np.where(go, ones, 0)
            w = np.where(go, w >> _U(half), part)
            at += np.where(go, half, 0)
        return at - bucket

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each number of ``x`` (sorted), or -1."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n or not len(x):
            return out
        bucket = (x >> _U(self.width)).astype(np.int64) if self.width < 64 else np.zeros(len(x), np.int64)
        here = np.flatnonzero((bucket <= self.top) & (bucket >= 0))
        if not len(here):
            return out
        bucket, want = bucket[here], x[here] & self.mask
        end = self.upto(bucket)
        a = np.where(bucket > 0, self.upto(np.maximum(bucket - 1, 0)), 0)
        b = end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self.lows(middle) < want[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        hit = np.flatnonzero(a < end)
        hit = hit[self.lows(a[hit]) == want[hit]]
        out[here[hit]] = a[hit]
        return out
