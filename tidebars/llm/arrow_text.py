"""Words and word n-gram hashes of Arrow string columns, computed over whole buffers with numpy.

Texts are looked at as UTF-8 bytes. Word hashes are 64-bit polynomials modulo 2**64 over random byte
codes, scrambled afterwards; equality of two hashes stands for equality of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 0x5DEECE66D
#: Bytes of text handled at a time; one longer text is handled alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(_SEED)) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Not in words of ASCII letters, digits and non-ASCII characters.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 2 * CHUNK)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(m, _BASE, U64), np.full(m, inverse, U64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes, and offsets into those bytes, of runs of about CHUNK bytes."""
    if len(column) == 0:
        return
    data, at = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_bounds(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the number of words before each text (n + 1)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~separators[_LOWER[data] if lower else data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = _power_tables(len(data) + 1)
    codes = _CODES[_LOWER] if lower else _CODES
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; meaningless for the last k - 1 words of a text."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = words[:m].copy()
    for j in range(1, k):
        total = total * U64(0xD6E8FEB86659FD93) + words[j : j + m]
    return mix(total + U64(k))


def shingle_sets(column: pa.Array, k: int = 5, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct k-word shingle hashes of each text.

    A text with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    for lo, hi, data, at in chunks(column):
        starts, ends, before = word_bounds(data, at)
        words = word_hashes(data, starts, ends, lower)
        grams = ngram_hashes(words, k)
        for i in range(hi - lo):
            a, b = int(before[i]), int(before[i + 1])
            if b - a >= k:
                yield lo + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield lo + i, ngram_hashes(words[a:b], b - a)
            else:
                yield lo + i, np.zeros(0, U64)
