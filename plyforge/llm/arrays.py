"""Vectorised words, hashes and packed blocks over Arrow batches.

Texts are read as UTF-8 bytes straight from Arrow buffers, in blocks of bounded size (one very long
text is a block of its own). Word hashes are 64-bit polynomials over randomised byte values, so they
are the same in every process and need no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240607)


def _folded(table: np.ndarray) -> np.ndarray:
    table[65:91] = table[97:123]
    return table


#: A random value for each byte; A-Z have those of a-z, so hashing lower-cases.
BYTE_VALUE = _folded(_RNG.integers(1, 2**64 - 1, 256, dtype=U64))
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, U64))
#: For words beyond 4,096 bytes, by the place's upper bits; made longer where a word needs it.
_FAR = np.ones(1, U64)
_STEP = 1 << 15
#: Odd multipliers that make a hash of several words depend on their order.
PLACE = _RNG.integers(1, 2**64 - 1, 64, dtype=U64) | U64(1)

_ALL = np.arange(256)
#: Words are what is between space, \t, \n, \v, \f and \r.
SPACED = ~np.isin(_ALL, [32, 9, 10, 11, 12, 13])
#: Words are digits, letters and what is beyond ASCII.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of a binary column without nulls, at most ``most`` bytes or one row each."""
    values = batch.column(column)
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    n = len(values)
    if not n:
        return
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in a block, and each row's first word (with one more entry for the end)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    is_word = kind[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = is_word[inner]
    ends[inner - 1] = is_word[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z taken as a-z."""
    if not len(starts):
        return np.empty(0, U64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64)
    place -= np.repeat(first, sizes)
    source = np.repeat(starts, sizes)
    source += place
    value = BYTE_VALUE[data[source]]
    value *= _POWER[place & 4095]
    if (most := int(sizes.max())) > 4096:
        value *= _far((most >> 12) + 1)[place >> 12]
    return mix(np.add.reduceat(value, first) + sizes.astype(U64) * U64(0xD6E8FEB86659FD93))


def _far(n: int) -> np.ndarray:
    global _FAR
    if n > len(_FAR):
        _FAR = np.concatenate((np.ones(1, U64), np.cumprod(np.full(2 * n, _POWER[-1], U64))))
    return _FAR


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """word_hashes of words that make up most of a block, by differences of sums over all its bytes."""
    if not len(starts):
        return np.empty(0, U64)
    powers, inverse = _step_powers()
    far = _powers(int(powers[-1]), -(-len(data) // _STEP))
    back = _powers(pow(int(powers[-1]), -1, 1 << 64), len(far))
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    for i, f in enumerate(far):
        part = BYTE_VALUE[data[i * _STEP : (i + 1) * _STEP]]
        part *= powers[: len(part)]
        part *= f
        total[i * _STEP + 1 : i * _STEP + 1 + len(part)] = part
    np.cumsum(total, out=total)
    h = (total[ends] - total[starts]) * inverse[starts & (_STEP - 1)]
    h *= back[starts // _STEP]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers from 0 to n - 1."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out)


@cache
def _step_powers() -> tuple[np.ndarray, np.ndarray]:
    """The place multipliers of a step's bytes, and their inverse from power 0 on."""
    base = int(_POWER[0])
    return _powers(base, _STEP + 1)[1:], _powers(pow(base, -1, 1 << 64), _STEP)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; it may span rows, so mask with row bounds."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.full(n, (k * 0xA24BAED4963EE407) % 2**64, U64)
    for j in range(k):
        total += hashes[j : j + n] * PLACE[j]
    return mix(total)


def whole(hashes: np.ndarray) -> int:
    """The gram of all of fewer than 64 words, as grams() hashes it."""
    return int(grams(hashes, len(hashes))[0])


def planes(values: np.ndarray) -> bytes:
    """The bytes of an unsigned array by significance: high planes of small numbers compress to nothing."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    if not len(sizes):
        return np.empty(0, np.int64)
    return np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
