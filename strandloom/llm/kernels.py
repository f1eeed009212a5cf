"""NumPy kernels over the UTF-8 buffers of Arrow string columns.

Everything here is vectorised over a slice of rows and keeps no state between
slices, so a task's memory follows the slice size (about a quarter megabyte of text,
or one document if that is larger) and not the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by the kernels.
SLICE_BYTES = 1 << 18

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x + _C1
    x ^= x >> np.uint64(30)
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


#: One random odd 64-bit code for each byte value (rolling hashes).
CODES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20)) | np.uint64(1)
#: ASCII upper case to lower case, byte by byte.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: White space of the contracts: blank and the controls 9 to 13.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True

def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column of the batch with nulls as empty strings."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rebased to 0) of a string or binary column."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = col.buffers()
    if len(col) == 0 or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose text has at most ``limit`` bytes, or one row each."""
    _, off = buffers(column(batch, name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def release() -> None:
    """Give the memory of a finished task back to the system: a reused worker would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(scan: Callable) -> Callable:
    """``scan``, a generator over batches for mapInArrow or an iterator UDF, that ends with ``release``."""

    @wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            release()

    return run


@dataclass
class Spans:
    """Pieces of a slice's text: byte ranges, owning row and 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    n_rows: int

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def row_starts(self) -> np.ndarray:
        """Index of each row's first piece, and the total at the end."""
        return np.concatenate([[0], np.cumsum(self.per_row())])


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LANE = np.uint64(0xA24BAED4963EE407)
_SEEDS = mix64(np.arange(2, dtype=np.uint64) + np.uint64(1 << 33))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, *which: int) -> np.ndarray | list[np.ndarray]:
    """A 64-bit hash of each byte range, for each of the seeds ``which`` (seed 0 alone if none is given).

    A range is read in lanes of eight bytes from its start, the last one filled with
    zeros. Each lane is scrambled with its position by splitmix64, twice; the hash is
    the scrambled sum with the length. No algebra relates a lane's value to its
    place, unlike polynomials modulo 2**64, which text of the Thue-Morse kind
    collides. Two seeds give a digest of 128 bits.
    """
    size = end - start
    lanes = (size + 7) >> 3
    total = int(lanes.sum())
    first = np.cumsum(lanes) - lanes
    j = np.arange(total) - np.repeat(first, lanes)
    at = np.repeat(start, lanes) + 8 * j
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    lane = np.ndarray(len(data) + 1, "<u8", wide, 0, (1,))[at] & _TAIL[np.minimum(np.repeat(end, lanes) - at, 8)]
    place = (j + 1).astype(np.uint64) * _LANE
    some = lanes > 0
    out = []
    for k in which or (0,):
        h = np.zeros(len(size), np.uint64)
        if total:
            h[some] = np.add.reduceat(mix64(mix64(lane + _SEEDS[k]) ^ place), first[some])
        out.append(mix64(h + size.astype(np.uint64) * _C1))
    return out if which else out[0]


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = ASCII_SPACE) -> Spans:
    """Maximal runs of bytes that are no gap; a run never crosses two rows."""
    n, rows = len(data), len(off) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Spans(z, z, z, np.zeros(0, np.uint64), rows)
    inside = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge[:-1]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(off, start, "right") - 1
    return Spans(start, end, row, span_hash(data, start, end), rows)


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of all lines; a row of n line feeds has n + 1 lines."""
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(off, feeds, "right") - 1
    count = np.bincount(row, minlength=len(off) - 1) + 1
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    total = int(count.sum())
    start, end = np.empty(total, np.int64), np.empty(total, np.int64)
    at = np.arange(len(feeds)) + row  # the line that ends with each feed
    start[first] = off[:-1]
    start[at + 1] = feeds + 1
    end[at] = feeds
    if len(count):
        end[first + count - 1] = off[1:]
    return start, end, np.repeat(np.arange(len(off) - 1), count)


def strip(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without white space at both ends."""
    solid = np.flatnonzero(~ASCII_SPACE[data])
    i = np.searchsorted(solid, start)
    j = np.searchsorted(solid, end) - 1
    some = i <= j
    if not len(solid):
        return start, start.copy()
    s = np.where(some, solid[np.minimum(i, len(solid) - 1)], start)
    e = np.where(some, solid[np.maximum(j, 0)] + 1, start)
    return s, e


def code_points(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of code points in each byte range."""
    pre = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return pre[end] - pre[start]


_Q = [np.uint64(x) for x in mix64(np.arange(64, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)]


def windows(spans: Spans, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first piece of all runs of ``size`` pieces within a row."""
    n = len(spans.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += spans.hash[j : j + n] * _Q[j]
    keep = np.flatnonzero(spans.row[:n] == spans.row[size - 1 :])
    return mix64(h[keep]), keep


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return x.view(np.int64)


def repeated(key: np.ndarray) -> np.ndarray:
    """True where a value occurs again in the array."""
    if len(key) == 0:
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(key), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def later(key: np.ndarray) -> np.ndarray:
    """True where an earlier position has the same value."""
    if len(key) == 0:
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    s = key[order]
    out = np.zeros(len(key), bool)
    out[order[1:][s[1:] == s[:-1]]] = True
    return out
