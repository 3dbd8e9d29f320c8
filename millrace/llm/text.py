"""Vectorised words and shingles over Arrow text columns (executor side, numpy).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; all of these are ASCII, so
splitting UTF-8 bytes splits code points correctly. Texts are handled in chunks of a few MB
(one longer text makes a chunk of its own), which bounds a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_PRIME = (1 << 31) - 1
_PRIME_BASE = 1_481_765_933
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2^31 - 1, for x below 2^62 (the prime itself may stand for 0)."""
    x = (x & U64(_PRIME)) + (x >> U64(31))
    return (x & U64(_PRIME)) + (x >> U64(31))


def _prime_powers(base: int, size: int) -> np.ndarray:
    """base^0 ... base^(size - 1) modulo the prime, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < size:
        out = np.concatenate([out, _reduced(out * U64(pow(base, len(out), _PRIME)))])
    return out[:size]


class _Powers:
    """Powers of the hash bases and of their inverses, kept per worker and grown on demand."""

    up = down = prime_up = prime_down = np.ones(1, dtype=np.uint64)

    @classmethod
    def wide(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=np.uint64))
        return cls.up, cls.down

    @classmethod
    def prime(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.prime_up) < n:
            size = max(n, CHUNK_BYTES + 1)
            cls.prime_up, cls.prime_down = _prime_powers(_PRIME_BASE, size), _prime_powers(pow(_PRIME_BASE, -1, _PRIME), size)
        return cls.prime_up, cls.prime_down


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, checked: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same in every process.

    Two polynomials of the bytes, one modulo 2^64 and one modulo a prime: words built by doubling,
    which can meet in the first, differ in the second. A caller that compares the bytes of equal
    hashes (``checked``) gets the first alone.
    """
    n = len(data)
    up, down = _Powers.wide(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    wide = (sums[end] - sums[start]) * down[start]
    if checked:
        return mix(wide ^ (end - start).astype(np.uint64))
    up, down = _Powers.prime(n + 1)
    terms = data * up[:n]  # below 2^39; folded once, a text of 2^32 bytes still sums without overflow
    np.cumsum((terms & U64(_PRIME)) + (terms >> U64(31)), out=sums[1:])
    own = _reduced(_reduced(sums[end] - sums[start]) * down[start])
    own = np.where(own == U64(_PRIME), U64(0), own)
    return mix(wide ^ mix(own << U64(32) | (end - start).astype(np.uint64)))


class Words:
    """Word spans of the rows of one chunk: ``start``/``end`` in bytes; row r has words ptr[r]:ptr[r+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        ink = ~SPACE[data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = ink[:-1]
            after[:-1] = ink[1:]
            cut = offsets[(offsets > 0) & (offsets < n)]
            before[cut] = False
            after[cut - 1] = False
        self.start = np.flatnonzero(ink & ~before)
        self.end = np.flatnonzero(ink & ~after) + 1
        self.ptr = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, the same in every process."""
        return span_hashes(self.data, self.start, self.end)

    def shingles(self, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ptr): every k-word window of each row, in order, repeats included.

        A row of fewer than k words has its whole sequence as one shingle (or none, by the flag);
        a row without words has none.
        """
        h, n = self.hashes(), np.diff(self.ptr)
        count = np.where(n >= k, n - k + 1, (n > 0) & whole_if_short).astype(np.int64)
        ptr = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(count, out=ptr[1:])
        row = np.repeat(np.arange(len(n)), count)
        first = self.ptr[:-1][row] + np.arange(ptr[-1]) - ptr[:-1][row]
        size = np.minimum(n[row], k)
        out = size.astype(np.uint64) * U64(0xD6E8FEB86659FD93)
        padded = np.concatenate([h, np.zeros(k, dtype=np.uint64)])
        for j in range(k):
            part = mix(padded[first + j] + U64(0xA24BAED4963EE407 * (j + 1) % 2**64)) * U64(pow(int(_BASE), 2 * j + 1, 1 << 64))
            out = out + np.where(j < size, part, U64(0))
        return mix(out), ptr


def map_texts(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of at most about BATCH_BYTES, so that texts of any length bound a task's memory.

    The session's Arrow setting is read when a job starts, not when the plan is made, so it is set here
    unless the session has a lower one of its own; one longer text is a batch of its own.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    at = df.sparkSession.conf.get(name).rstrip("b")
    if not (at.isdigit() and 0 < int(at) <= BATCH_BYTES):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def row_chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their text column."""
    for batch in batches:
        if batch.num_rows:
            data, off = bytes_of(batch.column(text))
            for i, j in chunks(off):
                yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
