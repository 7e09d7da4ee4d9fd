"""Vectorised kernels over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
#: bytes of text handled at once
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply); changes a copy."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_pow.get("r", ())) < max(1, n):
        m = max(n, CHUNK + 1)
        for key, base in (("r", _R), ("i", _R_INV)):
            p = np.full(m, base, U64)
            p[0] = 1
            _pow[key] = np.cumprod(p, dtype=U64)
    return _pow["r"][:n], _pow["i"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash``; values are unsigned and should not be 0."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * powers(len(values))[0], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span, equal for equal contents wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U64))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", chunk: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches cut to about ``chunk`` bytes of text (one row at least): batch, bytes, starts, ends. Null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        valid = np.ones(len(col), bool) if not col.null_count else np.asarray(col.is_valid())
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(off, off[i] + chunk, "right")) - 1)
            start, end = off[i:j] - off[i], off[i + 1 : j + 1] - off[i]
            end = np.where(valid[i:j], end, start)
            yield batch.slice(i, j - i), data[off[i] : off[j]], start, end
            i = j


_WORD = np.arange(256, dtype=np.uint8)
_WORD[0x41:0x5B] += 0x20
_WORD[0x00:0x30] = _WORD[0x3A:0x41] = _WORD[0x5B:0x61] = _WORD[0x7B:0x80] = 0


def words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in text order and, for each row, the first and past-the-last of its words.

    A word is a longest run of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters.
    """
    low = _WORD[data]
    word = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[start] = edge[end] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hash(prefix_hash(low), ws, we)
    return hashes, np.searchsorted(ws, start), np.searchsorted(ws, end)


def lower_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased and 0 outside words; start, end and row of each word, in text order.

    A word is a longest run of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters.
    """
    low = _WORD[data]
    word = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[start] = edge[end] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    held = np.searchsorted(ws, end) - np.searchsorted(ws, start)
    return low, ws, we, np.repeat(np.arange(len(start)), held)


def shingles(h: np.ndarray, first: np.ndarray, last: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words, and how many each row has; a row of fewer words, but not none, has one."""
    n = last - first
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    starts = np.repeat(first, count) + ragged(count)
    if not len(starts):
        return np.zeros(0, U64), count
    width_of = np.repeat(np.minimum(n, width), count)
    pre = prefix_hash(h)
    return span_hash(pre, starts, starts + width_of), count


def ragged(count: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, concatenated."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
