"""Vectorised byte and word kernels shared by the operators that run in Arrow batches.

Texts arrive as Arrow string arrays and are handled as one flat ``uint8`` array with document
offsets, so the cost of a word is a few numpy passes over its bytes and not a Python object.
All hashing is 64-bit, seeded by constants, and the same on every machine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, BLOCK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


def table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes that end a word: white space alone, or everything in ASCII but digits and lower-case letters.
BLANK = table((0x20, 0x20), (0x09, 0x0D))
PUNCT = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection for each seed."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; much faster on hashes than a hash table of them."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins; null is empty."""
    a = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    a = a.fill_null("").cast(pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, most: int):
    """Runs of documents of about ``most`` bytes; a longer document is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and the index of each document's first word."""
    inside = ~ends_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = False, inside
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's bytes, by prefix sums over blocks of bytes."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        at = starts[i]
        j = int(np.searchsorted(ends, at + BLOCK, "right"))
        if j <= i:  # one word that is longer than a block
            out[i] = int.from_bytes(hashlib.blake2b(data[at : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        span = data[at : ends[j - 1]].astype(np.uint64)
        span += np.uint64(1)
        total = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(span * _POW[: len(span)], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        i = j
    return mix(out)


def grams(values: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Polynomial hash of each run of n values, by doubling; len(values) - n + 1 of them."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out, have, power, width = None, 0, values, 1
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, width
            else:
                m = len(values) - have - width + 1
                out = out[:m] * np.uint64(pow(base, width, 1 << 64)) + power[have : have + m]
                have += width
        rest >>= 1
        if rest:
            m = len(power) - width
            power = power[:m] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
            width *= 2
    return out


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each run of n bytes by prefix sums; at most BLOCK bytes at once."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[: len(data)], out=total[1:])
    return (total[n:] - total[:m]) * _INV[:m]


def whole(woff: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the ``total`` runs of n words that start at each word lie in one document."""
    ok = np.zeros(max(total, 0), bool)
    if total > 0:
        last = np.repeat(woff[1:], np.diff(woff))[:total]
        ok = np.arange(total) + n <= last
    return ok


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of ``total`` places that lie within n of a start."""
    step = np.bincount(starts, minlength=total + 1) - np.bincount(np.minimum(starts + n, total), minlength=total + 1)
    return np.cumsum(step[:total]) > 0
