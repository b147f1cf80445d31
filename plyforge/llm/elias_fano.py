"""Elias-Fano lists of non-decreasing numbers on plain arrays, with vectorised access and successor search.

The lower bits of all numbers are packed at their exact width; the upper bits are unary, with the count of
ones before each word and the word of every 64th zero as directories. Buckets (numbers with the same upper
bits) of more than 32 are cut into even ranges of the lower bits, whose first indices are kept. Arrays are
read where they are, so they may be memory-mapped.
"""

from __future__ import annotations

import numpy as np

from .arrays import U64, ragged

_ALL, _ONE = U64(0xFFFFFFFFFFFFFFFF), U64(1)
_A, _B, _C, _BYTES, _TOPS = (U64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))
#: Where the k-th one of a byte stands.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _at = [b for b in range(8) if _byte >> b & 1]
    _IN_BYTE[_byte, : len(_at)] = _at


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the k-th one (from 0) of each 64-bit word stands."""
    s = words - ((words >> _ONE) & _A)
    s = (s & _B) + ((s >> U64(2)) & _B)
    s = ((s + (s >> U64(4))) & _C) * _BYTES  # byte i: ones of bytes 0 to i
    k = k.astype(U64)
    byte = np.bitwise_count(((k * _BYTES | _TOPS) - s) & _TOPS).astype(U64) << U64(3)
    left = k - (((s << U64(8)) >> byte) & U64(255))
    return byte.astype(np.int64) + _IN_BYTE[((words >> byte) & U64(255)).astype(np.int64), left.astype(np.int64)]


def _lowest(words: np.ndarray) -> np.ndarray:
    """Where the lowest one of each word stands; 64 without ones."""
    return np.bitwise_count((words & (~words + _ONE)) - _ONE).astype(np.int64)


class Packed:
    """Unsigned numbers of one width in bits, one after the other."""

    def __init__(self, words: np.ndarray, width: int) -> None:
        self.words, self.width = words, width
        self.mask = U64((1 << width) - 1)

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> Packed:
        n = len(values)
        words = np.zeros(n * width // 64 + 2, U64)
        if n and width:
            values = values.astype(U64)
            bit = np.arange(n, dtype=np.int64) * width
            word, shift = bit >> 6, (bit & 63).astype(U64)
            some = int(word[-1]) + 1  # each of them holds the start of a number
            words[:some] = np.bitwise_or.reduceat(values << shift, -(-64 * np.arange(some, dtype=np.int64) // width))
            over = np.flatnonzero((bit & 63) + width > 64)
            words[word[over] + 1] |= values[over] >> (U64(64) - shift[over])
        return cls(words, width)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        return ((self.words[word] >> shift) | ((self.words[word + 1] << _ONE) << (U64(63) - shift))) & self.mask


LARGE = 32


class EliasFano:
    """``search`` are the directories of the search: words of zeros, large buckets, where their ranges are (64 * first + log2 of their number), and the ranges' first indices. A list without them is read by index."""

    def __init__(self, arrays: list[np.ndarray], n: int, bits: int) -> None:
        low, self.upper, self.ones, *self.search = arrays
        self.low, self.n, self.bits = Packed(low, bits), n, bits

    @classmethod
    def build(cls, values: np.ndarray, universe: int, searched: bool = True) -> EliasFano:
        """values: sorted, below universe."""
        n = len(values)
        values = values.astype(U64)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        at = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((n + (universe >> bits) + 1) // 64 + 3) * 64, bool)
        flags[at] = True
        upper = np.packbits(flags, bitorder="little").view(U64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)[:-1])).astype(np.uint32 if n < 2**32 else np.int64)
        search = []
        if searched:
            before = 64 * np.arange(len(ones)) - ones.astype(np.int64)
            zeros = np.searchsorted(before, np.arange(0, int(before[-1]), 64), "right") - 1
            zeros = np.append(zeros, len(upper) - 1).astype(np.uint32 if len(upper) < 2**32 else np.int64)
            search = [zeros, *cls._large(values, bits)]
        return cls([Packed.build(values & U64((1 << bits) - 1), bits).words, upper, ones, *search], n, bits)

    @staticmethod
    def _large(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bucket = values >> U64(bits)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(values)])
        size = np.diff(np.append(first, len(values)))
        first, size = first[size > LARGE], size[size > LARGE]
        log = np.minimum(np.frexp(size - 1)[1] - 4, bits)  # 8 to 16 in a range
        ranges = 1 << log
        begin = np.cumsum(ranges + 1) - ranges - 1
        step = ragged(np.zeros(len(ranges), np.int64), ranges)
        start = np.repeat(bucket[first] << U64(bits), ranges) + (step.astype(U64) << np.repeat(bits - log, ranges).astype(U64))
        index = np.empty(int((ranges + 1).sum()), np.uint32 if len(values) < 2**32 else np.int64)
        index[ragged(begin, ranges)] = np.searchsorted(values, start)
        index[begin + ranges] = first + size
        return bucket[first].astype(np.int64), begin * 64 + log, index

    def arrays(self) -> list[np.ndarray]:
        return [self.low.words, self.upper, self.ones, *self.search]

    def _one(self, i: np.ndarray) -> np.ndarray:
        """Positions of the i-th ones of the upper bits."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        return word * 64 + _select(self.upper[word], i - self.ones[word].astype(np.int64))

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by index."""
        return ((self._one(i) - i).astype(U64) << U64(self.bits)) | self.low[i]

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and i + 1."""
        one = self._one(i)
        word, bit = one >> 6, (one & 63).astype(U64)
        left = self.upper[word] & ((_ALL << _ONE) << bit)
        while len(empty := np.flatnonzero(left == 0)):
            word[empty] += 1
            left[empty] = self.upper[word[empty]]
        following = word * 64 + _lowest(left)
        return ((one - i).astype(U64) << U64(self.bits)) | self.low[i], ((following - i - 1).astype(U64) << U64(self.bits)) | self.low[i + 1]

    def _after_zeros(self, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The positions just after the h-th zeros, which lie in the words from low to high."""
        sample = (h - 1) >> 6
        low = np.maximum(low, self.search[0][sample])
        high = np.minimum(high, self.search[0][sample + 1])
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) >> 1
            ok = 64 * middle - self.ones[middle].astype(np.int64) < h[open_]
            low[open_[ok]] = middle[ok]
            high[open_[~ok]] = middle[~ok] - 1
        return low * 64 + _select(~self.upper[low], h - 1 - (64 * low - self.ones[low].astype(np.int64))) + 1

    def successor(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the values with index from start to end (all below start being less than x, those from end on more): an index, and whether x is there."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        x = x.astype(U64)
        h, want = (x >> U64(self.bits)).astype(np.int64), x & U64((1 << self.bits) - 1)
        _, large, where, index = self.search
        low, high = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        small = np.ones(len(x), bool)
        if len(large):
            rows = np.flatnonzero(end - start > LARGE)
            at = np.minimum(np.searchsorted(large, h[rows]), len(large) - 1)
            same = large[at] == h[rows]
            rows, at = rows[same], where[at[same]]
            at = (at >> 6) + (want[rows] >> (self.bits - (at & 63)).astype(U64)).astype(np.int64)
            low[rows], high[rows] = np.maximum(index[at], start[rows]), np.minimum(index[at + 1], end[rows])
            small[rows] = False
        rows = np.flatnonzero(small)
        low[rows], high[rows] = self._bucket(h[rows], start[rows], end[rows])
        found = low < high
        high -= 1  # what is less than x before it leaves it
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            less = self.low[middle] < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        at = np.flatnonzero(found)
        found[at] = self.low[low[at]] == want[at]
        return low, found

    def _bucket(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of indices that a bucket has between start and end."""
        # where the bucket begins, or index start where that lies within it
        begin = h + start
        word = begin >> 6
        before = self.ones[word].astype(np.int64) + np.bitwise_count(self.upper[word] & ((_ONE << (begin & 63).astype(U64)) - _ONE))
        ahead = np.flatnonzero(begin - before < h)
        begin[ahead] = self._after_zeros(h[ahead], word[ahead], (h[ahead] + end[ahead]) >> 6)
        # how many values follow in the bucket: ones in a row
        word, bit = begin >> 6, (begin & 63).astype(U64)
        run = _lowest(~((self.upper[word] >> bit) | ((self.upper[word + 1] << _ONE) << (U64(63) - bit))))
        low = begin - h
        high = low + run
        long = np.flatnonzero(run == 64)
        if len(long):
            # where the bucket goes on beyond end, its zero is not looked for
            most = (h[long] + end[long]) >> 6
            inside = 64 * (most + 1) - self.ones[most + 1].astype(np.int64) > h[long]
            high[long] = end[long]
            long, most = long[inside], most[inside]
            high[long] = self._after_zeros(h[long] + 1, word[long], most) - 1 - h[long]
        return low, np.minimum(high, end)
