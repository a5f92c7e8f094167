"""Texts of an Arrow batch as numpy arrays: byte classes, words, and 64-bit rolling hashes of words and n-grams.

A batch is cut into blocks of whole texts of about BLOCK bytes (a longer text is a block of its own), so memory
follows the block or the longest text, not the batch. Hashes are polynomials modulo 2**64 over random byte values,
mixed afterwards; two different words or n-grams agree with a chance of about 2**-60.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240101))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def released(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step, after which a Python worker gives freed memory back to the system: workers outlive their tasks, and what they keep adds up in an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true within the given closed ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Separators of words [^\x20\x09-\x0D]+.
BLANKS = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z are lowered).
PUNCTUATION = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * BLOCK:
            _powers[int(base)] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of texts of about `limit` bytes."""
    data, off = buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@dataclass
class Words:
    start: np.ndarray  # of each word, in bytes of the block
    end: np.ndarray
    doc: np.ndarray  # the text's place in the block
    first: np.ndarray  # place of each text's first word; n + 1 of them
    hash: np.ndarray  # 64 bits

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes; a run doesn't pass from one text to the next."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, z = inside.copy(), inside.copy()
    a[1:] &= ~inside[:-1]
    z[:-1] &= ~inside[1:]
    some = off[:-1] < off[1:]
    a[off[:-1][some]] |= inside[off[:-1][some]]
    z[off[1:][some] - 1] |= inside[off[1:][some] - 1]
    return np.flatnonzero(a), np.flatnonzero(z) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, by prefix sums of one polynomial."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _power(BASE, n), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * _power(BASE_INV, n + 1)[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    start, end = runs(~separators[data], off)
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(start, end, doc, first, span_hashes(data, start, end))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they stay within the text."""
    m = len(w.hash)
    out = np.zeros(m, np.uint64)
    for k in range(min(n, m)):
        out[: m - k] += w.hash[k:] * np.uint64((0xD1342543DE82EF95 * (2 * k + 1) + 2 * k) & (2**64 - 1) | 1)
    ok = np.zeros(m, bool)
    if m >= n:
        ok[: m - n + 1] = w.doc[: m - n + 1] == w.doc[n - 1 :]
    return mix(out), ok


def code_points(data: np.ndarray) -> np.ndarray:
    """1 at each byte that begins a code point."""
    return (data & 0xC0) != 0x80
