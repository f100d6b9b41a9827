"""Words and hashes of text columns, by numpy over the UTF-8 bytes of Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are
polynomials modulo 2**64 over random byte codes, taken from running sums, then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
LOWER_CODES = CODES[LOWER]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; kept and extended per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 24:
            _powers[base] = have
    return have[:n]


def trim() -> None:
    """Hand freed memory back to the system: a Python worker lives on after its task."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``limit``; a larger row is a range of its own."""
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    at = 0
    while at < len(sizes):
        end = int(np.searchsorted(total, total[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(sizes))
        yield at, end
        at = end


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of whole rows with about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for start, end in runs(sizes, limit):
            yield batch.slice(start, end - start)
    trim()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each row; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and per row the number of its first word (rows + 1 entries)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~SPACE[data]
    begins, closes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = solid[edges]
    closes[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def spans_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of codes[start:end] for every span, wherever it lies."""
    total = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * powers(BASE, len(codes)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(codes) + 1)[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return spans_hash((LOWER_CODES if lower else CODES)[data], starts, ends)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the words at which a window of ``width`` words of one row starts."""
    total = int(first[-1])
    if total < width:
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(total + 1, dtype=np.int64)
    counts = np.diff(first)
    rows = counts >= width
    np.add.at(change, first[:-1][rows], 1)
    np.add.at(change, first[1:][rows] - width + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and how often each occurs."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[edge], np.diff(np.concatenate((edge, [len(values)])))


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal values added up; the values come back sorted."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[edge], np.add.reduceat(counts, edge)
