"""Vectorised text kernels over Arrow buffers: words, hashes and documents of a batch, in bounded pieces."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; longer documents are handled whole, in pieces of this size where bytes are hashed.
PIECE = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Spans beyond this many bytes are hashed by BLAKE2b: a polynomial modulo 2**64 confuses some regular strings of 1024 bytes and more.
LONG_SPAN = 256
#: Words between ASCII white space.
PLAIN_WORD = ~WHITE
#: Words of ASCII digits, ASCII letters (looked up in lower case) and all bytes beyond ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def frugal(function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function, which gives the memory that it has freed back to the system when a task ends: workers live on through later stages."""

    @functools.wraps(function)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim"):  # glibc
                ctypes.CDLL(None).malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and each text's offsets; null counts as empty. The bytes aren't copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    for _ in range(2):
        _, where, data = column.buffers()
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if not column.null_count or not np.diff(offsets)[~column.is_valid().to_numpy(zero_copy_only=False)].any():
            break
        column = pc.fill_null(column, "")  # a null with bytes of its own
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` documents with at most limit bytes together, or a single document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(i + most, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE, inverse: np.uint64 = BASE_INV) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n, at least."""
    found = _powers.get(int(base))
    if found is None or len(found[0]) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, base, U), np.full(size, inverse, U)
        up[0] = down[0] = 1
        found = _powers[int(base)] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return found


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of spans of bytes (in order, not overlapping), and for each of `prefixes` a row with the hashes of that many first bytes.

    Spans are taken in pieces of about PIECE bytes, so that the tables of powers stay short. A span no longer than the prefix has its own hash there;
    prefixes are at most LONG_SPAN.
    """
    hashes = np.empty(len(starts), U)
    begins = np.empty((len(prefixes), len(starts)), U)
    k = 0
    while k < len(starts):
        at = starts[k]
        m = max(k + 1, int(np.searchsorted(ends, at + PIECE, "right")))
        up, down = powers(int(ends[m - 1] - at))
        part = low[at : ends[m - 1]]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[k:m] - at, ends[k:m] - at
        hashes[k:m] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        for row, n in zip(begins, prefixes, strict=True):
            row[k:m] = np.where(e - s > n, mix((sums[np.minimum(s + n, e)] - sums[s]) * down[s] + U(n << 32)), hashes[k:m])
        k = m
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, begins


class Words:
    """The words of some documents: starts and ends in the bytes, hashes, and offsets (words before each document).

    prefixes: for each of these numbers of bytes, a row of `begins` with the hashes of the words' beginnings.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = PLAIN_WORD, prefixes: tuple[int, ...] = ()):
        low = LOWER[data]
        inside = is_word[low]
        before = np.zeros(len(low) + 1, bool)
        before[1:] = inside
        before[offsets[:-1]] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(low) + 1, bool)
        after[:-1] = inside
        after[offsets[1:]] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.hashes, self.begins = hash_spans(low, self.starts, self.ends, prefixes)

    def docs(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive hashes, whatever documents they are in."""
    if len(hashes) < n:
        return np.empty(0, U)
    out = np.full(len(hashes) - n + 1, U(n), U)
    for i in range(n):
        out *= U(0x9FB21C651E98DF25)
        out += hashes[i : len(hashes) - n + 1 + i]
    return mix(out)
