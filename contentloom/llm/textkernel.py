"""Vectorised words and word shingles over Arrow text batches.

All functions work on whole texts, one small piece of a batch at a time, so
temporary arrays stay a few MB large except for a single text that is larger
than a piece.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words when punctuation separates: ASCII letters and digits, and all of a multi-byte character (spaced() leaves those of words).
ALNUM = np.array([chr(i).isalnum() and i < 128 or i >= 128 for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_WORDS = multipliers(4096, 1 << 20)
#: An odd number, its inverse modulo 2**64, and their powers as far as the longest usual piece needs them.
ROOT = 0x9E3779B97F4A7C1D


def _powers(x: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, x, U64)]))


_UP, _DOWN = _powers(ROOT, PIECE + 1), _powers(pow(ROOT, -1, 1 << 64), PIECE + 1)
_LETTERS = mix(LOWER.astype(U64) + U64(1))


@lru_cache(1 << 16)
def _separates(c: str) -> bool:
    return c > "\x7f" and unicodedata.category(c)[0] not in "LMN"


def spaced(column: pa.Array) -> pa.Array:
    """Texts with a blank for each character beyond ASCII that is no letter, mark or digit; places in code points stay."""
    held = set().union(*(set(t) for t in column.to_pylist() if t and not t.isascii()))
    for c in filter(_separates, held):
        column = pc.replace_substring(column, c, " ")
    return column


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts; a null counts as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for chunk in chunks:
        chunk = (chunk.fill_null("") if chunk.null_count else chunk).cast(pa.large_string())
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            data = chunk.buffers()[2]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            a = 0
            while a < len(chunk):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
                yield first + a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                a = b
        first += len(chunk)


def words(data: np.ndarray, offsets: np.ndarray, wordly: np.ndarray = ~WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (and after the last)."""
    inside = wordly[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[full] = False
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    after[ends] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z: polynomials of their bytes, from running sums over the piece."""
    if not len(start):
        return np.zeros(0, U64)
    n = len(data)
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(ROOT, n), _powers(pow(ROOT, -1, 1 << 64), n))
    sums = np.zeros(n + 1, U64)
    terms = _LETTERS[data]
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    found = sums[end] - sums[start]
    found *= down[start]
    return mix(found)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words of each text (of all its words if fewer) and the bounds of each text's."""
    count = np.diff(bounds)
    many = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    out = np.zeros(int(many.sum()), U64)
    to = np.concatenate([[0], np.cumsum(many)])
    if len(hashes) >= size:
        every = np.zeros(len(hashes) - size + 1, U64)
        for j in range(size):
            every += hashes[j : j + len(every)] * _WORDS[j]
        first = np.repeat(bounds[:-1] - to[:-1], many) + np.arange(len(out))
        out = every[np.minimum(first, len(every) - 1)]
    for d in np.flatnonzero((count > 0) & (count < size)):
        run = hashes[bounds[d] : bounds[d + 1]]
        out[to[d]] = (run * _WORDS[: len(run)]).sum(dtype=U64) + U64(len(run))
    return mix(out), to


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, sorted distinct shingle hashes)."""
    for first, data, offsets in pieces(column):
        start, end, bounds = words(data, offsets)
        found, to = shingles(word_hashes(data, start, end), bounds, size)
        for d in range(len(offsets) - 1):
            yield first + d, np.unique(found[to[d] : to[d + 1]])
