"""Columns of byte spans, read by numpy inside tasks: a span is (start, end) in one buffer of bytes; start < 0 is null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_VALUE = np.random.Generator(np.random.PCG64(811)).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_WIDEST = 1 << 16  # bytes of a span that are hashed


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_at(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes at positions, 0 from ``end`` on."""
    ok = (at >= 0) & (at < end)
    return np.where(ok, data[np.where(ok, at, 0)], 0) if len(data) else np.zeros(len(at), dtype=np.uint8)


def equals(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: bytes, whole: bool = True) -> np.ndarray:
    """Whether spans are (or, not ``whole``, begin with) a text. Null spans are not."""
    size = end - start
    out = (start >= 0) & ((size == len(text)) if whole else (size >= len(text)))
    some = np.flatnonzero(out)
    for j, b in enumerate(text):
        some = some[data[start[some] + j] == b]
    out[:] = False
    out[some] = True
    return out


def integers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, known): the leading whole number of each span, with its sign. Beyond 64 bits: not known."""
    first = byte_at(data, start, end)
    minus, at = first == 45, start + ((first == 45) | (first == 43))
    value, digits = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
    live = np.flatnonzero(start >= 0)
    while len(live):
        c = byte_at(data, at[live] + digits[live], end[live]).astype(np.int64) - 48
        go = (c >= 0) & (c <= 9)
        live, c = live[go], c[go]
        value[live] = value[live] * 10 + c
        digits[live] += 1
    known = (digits > 0) & (digits <= 18)
    for i in np.flatnonzero(digits > 18):
        n = int(data[at[i] : at[i] + digits[i]].tobytes())
        known[i] = -(1 << 63) <= (-n if minus[i] else n) < 1 << 63
        value[i] = n - (1 << 64) if n >= 1 << 63 else n
    return np.where(minus, -value, value), known


def floats(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, known): the leading decimal number of each span, as Java reads it."""
    first = byte_at(data, start, end)
    minus, at = first == 45, start + ((first == 45) | (first == 43))
    whole, digits, dot, after = np.zeros(len(start)), np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=bool), np.zeros(len(start), dtype=np.int64)
    live = np.flatnonzero(start >= 0)
    while len(live):
        c = byte_at(data, at[live] + digits[live] + dot[live], end[live]).astype(np.int64)
        number = (c >= 48) & (c <= 57)
        point = (c == 46) & ~dot[live] & (digits[live] > 0)
        point &= np.isin(byte_at(data, at[live] + digits[live] + 1, end[live]), np.arange(48, 58))
        more = live[number]
        whole[more] = whole[more] * 10 + (c[number] - 48)
        digits[more] += 1
        after[more] += dot[more]
        dot[live[point]] = True
        live = live[number | point]
    value = whole / 10.0 ** np.minimum(after, 22)  # exact operands give the nearest double
    for i in np.flatnonzero((digits > 15) | (after > 22)):
        value[i] = float(data[at[i] : at[i] + digits[i] + dot[i]].tobytes())
    return np.where(minus, -value, value), digits > 0


def hexes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) of hexadecimal digits after an optional 0x."""
    mark = (byte_at(data, start, end) == 48) & np.isin(byte_at(data, start + 1, end), (88, 120)) & (_digit(byte_at(data, start + 2, end)) < 16)
    at = start + 2 * mark
    value, digits = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.int64)
    live = np.flatnonzero(start >= 0)
    while len(live):
        c = _digit(byte_at(data, at[live] + digits[live], end[live]))
        live, c = live[c < 16], c[c < 16]
        value[live] = value[live] * np.uint64(16) + c.astype(np.uint64)
        digits[live] += 1
    known = (digits > 0) & (digits <= 15)
    return value.astype(np.int64), known


def _digit(c: np.ndarray) -> np.ndarray:
    """The value of hexadecimal digits, 16 for other bytes."""
    c = c.astype(np.int64)
    low = c | 32
    return np.where((c >= 48) & (c <= 57), c - 48, np.where((low >= 97) & (low <= 102), low - 87, 16))


def texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as strings."""
    null = start < 0
    size = np.where(null, 0, end - start)
    off = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size, out=off[1:])
    raw = data[np.repeat(np.where(null, 0, start) - off[:-1], size) + np.arange(off[-1])] if off[-1] else np.zeros(0, dtype=np.uint8)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
    return pa.Array.from_buffers(pa.string(), len(start), [valid, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw)])


def count_before(data: np.ndarray, byte: int) -> np.ndarray:
    """How often a byte is before each position."""
    out = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(data == byte, dtype=np.int32, out=out[1:])
    return out


def unquoted(data: np.ndarray, start: np.ndarray, end: np.ndarray, quotes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spans without a quote at the start and the quote, if any, at the end, where there is no other quote; ``nil`` is empty.

    ``quotes`` is ``count_before`` of quotes, for callers with several columns of one buffer.
    """
    quotes = count_before(data, 34) if quotes is None else quotes
    nil = equals(data, start, end, b"nil")
    opens = byte_at(data, start, end) == 34
    inside = np.where(start < 0, 0, quotes[end] - quotes[start])
    closes = opens & (end - start > 1) & (byte_at(data, end - 1, end) == 34)
    both, one = closes & (inside == 2), opens & (inside == 1)
    return start + (both | one), np.where(nil, start, end - both)


def truths(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """False for empty spans, ``nil``, ``false`` and what begins with 0. Null spans are false."""
    first = byte_at(data, start, end)
    return (start >= 0) & (end > start) & (first != 48) & ~equals(data, start, end, b"nil") & ~equals(data, start, end, b"false")


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(texts, each span's place among them), for short spans of few different texts: told apart by 64-bit hashes of their first _WIDEST bytes."""
    if not len(start):
        return [], np.zeros(0, dtype=np.int64)
    h = np.zeros(len(start), dtype=np.uint64)
    live, j = np.arange(len(start)), 0
    while len(live) and j < _WIDEST:
        live = live[start[live] + j < end[live]]
        h[live] = h[live] * np.uint64(_STEP) + _VALUE[data[start[live] + j]]
        j += 1
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[first], end[first])], place
