"""Byte-level byte-pair encoding of many short strings at once, equal to the tokenizer's own.

Strings are joined and cut into pieces by the byte-level pre-tokenizer's rule, on arrays of characters. Pieces of like
length are the columns of a matrix; each round merges in every column its pair of lowest rank, the leftmost of equals,
until no column has a pair.

Strings with a character beyond the basic plane, one whose class differs between Unicode 3.2 and this Python's version (so that
the tokenizer's version might see it differently), or a piece of more than 64 bytes are left to the tokenizer.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np

NONE = np.iinfo(np.int32).max
LONGEST = 64
#: Pieces up to each length share a matrix.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 40, LONGEST)
BLOCK = 8192
LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
WHITE = [*range(9, 14), 0x20, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x3000]
RANK_BITS = 17


@cache
def classes() -> np.ndarray:
    """The pre-tokenizer's class of each character of the basic plane."""
    kinds, white = np.full(1 << 16, UNSURE, np.uint8), set(WHITE)
    for c in range(1 << 16):
        now, then = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        if c in white:
            kinds[c] = SPACE
        elif chr(c).isspace() or "Cn" in (now, then) or "Cs" in (now, then) or "Zs" in (now, then):
            continue
        elif now[0] in "LN" or then[0] in "LN":
            if now[0] == then[0]:
                kinds[c] = LETTER if now[0] == "L" else NUMBER
        else:
            kinds[c] = OTHER
    return kinds


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def starts_of_pieces(text: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ starts a piece of the strings that begin at first."""
    new = np.ones(len(text), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[first] = True
    last = np.zeros(len(text), bool)  # of its string
    last[first[1:] - 1] = True
    last[-1:] = True
    white = kind == SPACE
    # of a run of white space before something else the last is a piece of its own, or joins it if it is a space
    before = np.flatnonzero(white[:-1] & ~white[1:] & ~last[:-1])
    new[before] = True
    new[before[text[before] == 32] + 1] = False
    marks = np.flatnonzero(new & (text == 39))
    if marks.size:
        # up to two characters after it in the same string
        a, b = np.minimum(marks + 1, len(text) - 1), np.minimum(marks + 2, len(text) - 1)
        x = np.where(last[marks], 0, text[a])
        y = np.where((x == 0) | last[a], 0, text[b])
        two = np.isin(x, [ord(c) for c in "stmd"])
        three = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        for found, size in ((marks[two], 2), (marks[three], 3)):
            for k in range(1, size):
                new[found + k] = False
            ends = found + size
            new[ends[ends < len(text)]] = True
    return new


class BytePairs:
    """The merges of a tokenizer; symbols are bytes, then merges by rank."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        letters, vocabulary = byte_letters(), model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        symbol = {c: b for b, c in enumerate(letters)} | {a + b: 256 + k for k, (a, b) in enumerate(pairs)}
        self.ids = np.array([vocabulary[c] for c in letters] + [vocabulary[a + b] for a, b in pairs], "<u4")
        self.n = 257 + len(pairs)  # the last symbol is a gap, which no pair holds
        keys = np.array([symbol[a] * self.n + symbol[b] for a, b in pairs], np.int64)
        self.shift = np.uint64(64 - max(8, (4 * len(pairs)).bit_length()))
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        at, rank = self._slots(keys), np.arange(len(pairs))
        while rank.size:
            free = np.flatnonzero(self.table[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.table[at[placed]] = keys[rank[placed]] << RANK_BITS | rank[placed]
            rest = np.setdiff1d(np.arange(rank.size), placed)
            at, rank = (at[rest] + 1) % len(self.table), rank[rest]
        b = np.arange(256)
        self.of_bytes = self.rank(np.repeat(b, 256), np.tile(b, 256))

    @classmethod
    def of(cls, path: str) -> BytePairs | None:
        """None for a tokenizer of another kind."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {*byte_letters(), *(a + b for a, b in pairs)}
        # a string that is made in two ways would need one symbol for both
        if len(made) != 256 + len(pairs) or len(pairs) >= 1 << RANK_BITS or not made <= model["vocab"].keys() or not {x for p in pairs for x in p} <= made:
            return None
        return cls(spec)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NONE."""
        keys = left.astype(np.int64) * self.n + right
        at = self._slots(keys)
        got = self.table[at]
        found = got >> RANK_BITS
        out = np.where(found == keys, got & ((1 << RANK_BITS) - 1), NONE).astype(np.int32)
        again = np.flatnonzero((found != keys) & (got >= 0))
        while again.size:
            at[again] = (at[again] + 1) % len(self.table)
            got = self.table[at[again]]
            hit = got >> RANK_BITS == keys[again]
            out[again[hit]] = got[hit] & ((1 << RANK_BITS) - 1)
            again = again[~hit & (got >= 0)]
        return out

    def _merge(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> None:
        """Merges the pieces in symbols; what a merge takes away becomes -1."""
        n, gap = len(starts), self.n - 1
        column = np.arange(n, dtype=np.int64)
        place = np.arange(width, dtype=np.int64)[:, None]
        inside = place < sizes
        flat = np.where(inside, starts + place, 0)
        held = np.full((width + 1, n), gap, np.int64)  # row width stands for what is before and after
        held[:width] = np.where(inside, symbols[flat], gap)
        following = np.tile(np.arange(1, width + 2, dtype=np.int64)[:, None], (1, n))
        following[sizes - 1, column] = width
        earlier = np.tile(np.arange(-1, width, dtype=np.int64)[:, None], (1, n))
        earlier[0] = width
        pair = np.full((width + 1, n), NONE, np.int32)  # rank and place of the pair that starts there
        both = inside[1:] & inside[:-1]
        ranks = self.of_bytes[np.where(both, held[: width - 1] * 256 + held[1:width], 0)]
        pair[: width - 1] = np.where(both & (ranks < NONE), ranks << 6 | place[:-1], NONE)
        held, following, earlier, pairs = held.ravel(), following.ravel(), earlier.ravel(), pair.ravel()

        def ranked(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            ranks = self.rank(left, right)
            return np.where(ranks < NONE, ranks << 6 | at.astype(np.int32), NONE)

        while True:
            least = pair.min(axis=0)
            c = np.flatnonzero(least < NONE)
            if not c.size:
                break
            least = least[c].astype(np.int64)
            p, made = least & 63, (least >> 6) + 256
            at = p * n + c
            gone = following[at] * n + c
            q, o = following[gone], earlier[at]
            after, ahead = q * n + c, o * n + c
            held[at], held[gone], pairs[gone] = made, -1, NONE
            following[at], earlier[after] = q, p
            pairs[at] = ranked(made, held[after], p)
            pairs[ahead] = ranked(held[ahead], made, o)
        symbols[flat[inside]] = held.reshape(width + 1, n)[:width][inside]

    def encode(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the strings of UTF-8 between bounds, the bounds of each one's ids, and which are left to the tokenizer."""
        text = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        symbols = np.frombuffer(data, np.uint8).astype(np.int32)
        begin = (symbols & 0xC0) != 0x80
        begins = np.append(np.flatnonzero(begin), len(symbols))  # of characters, in bytes
        at = np.searchsorted(begins, bounds)
        first = at[:-1]
        kind = classes()[np.minimum(text, 0xFFFF)]
        kind[text > 0xFFFF] = UNSURE
        left = np.zeros(len(first), bool)
        left[np.searchsorted(at, np.flatnonzero(kind == UNSURE), side="right") - 1] = True
        new = starts_of_pieces(text, kind, first[first < len(text)])

        starts = begins[:-1][new]
        sizes = np.diff(np.append(starts, len(symbols)))
        left[np.searchsorted(bounds, starts[sizes > LONGEST], side="right") - 1] = True
        low = 1
        for width in WIDTHS:
            of = np.flatnonzero((sizes > low) & (sizes <= width))
            for k in range(0, len(of), BLOCK):
                some = of[k : k + BLOCK]
                self._merge(symbols, starts[some], sizes[some], width)
            low = width
        kept = symbols >= 0
        before = np.concatenate(([0], np.cumsum(kept)))
        return self.ids[symbols[kept]], before[bounds], left
