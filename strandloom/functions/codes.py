"""K-mers as numbers: NumPy kernels that read a sequence once, whatever its length.

A letter is two bits (A, C, G, T in this order), so a k-mer of up to 31 letters is a
number that orders like its string. Codes of all windows come from codes of shorter
windows by doubling, both strands at once. A slice of sequences is handled ``STEP``
windows at a time, so memory does not follow the longest read. Windows that hold
another letter have no code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_K = 31
STEP = 1 << 18
_TWO = np.full(256, 255, np.uint8)
for _i, _letter in enumerate(b"ACGT"):
    _TWO[_letter] = _i
_TEXT = np.frombuffer(b"ACGT", np.uint8)


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"a k-mer code holds 1 to {MAX_K} letters, not {k}")


def text(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def code(kmer: Column) -> Column:
    """The code of a k-mer."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def push_right(code: Column, letter: Column, k: int) -> Column:
    """The code of the window one letter on: the first letter goes, ``letter`` (0 to 3) comes."""
    return F.shiftleft(code.bitwiseAND((1 << 2 * (k - 1)) - 1), 2).bitwiseOR(letter.cast("long"))


def push_left(code: Column, letter: Column, k: int) -> Column:
    """The code of the window one letter back: ``letter`` comes in front, the last one goes."""
    return F.shiftright(code, 2).bitwiseOR(F.shiftleft(letter.cast("long"), 2 * (k - 1)))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls are empty."""
    col = col.fill_null("") if col.null_count else col
    raw = col.buffers()
    if len(col) == 0 or raw[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose sequences have at most ``limit`` letters, or one row each."""
    _, off = buffers(batch.column(name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def window_codes(two: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of every window of ``k`` letters (two bits each) and of its reverse complement."""
    n = len(two) - k + 1
    one = two.astype(np.uint32 if k <= 16 else np.int64) & 3
    done, ahead, back = 0, None, None  # codes of the first ``done`` letters of the window
    size, f, r = 1, one, 3 - one
    left = k
    while left:
        if left & 1:
            part_f, part_r = f[done : done + n], r[done : done + n]
            ahead, back = (part_f, part_r) if ahead is None else (ahead << (2 * size) | part_f, back | part_r << (2 * done))
            done += size
        left >>= 1
        if left:
            f, r = f[:-size] << (2 * size) | f[size:], r[:-size] | r[size:] << (2 * size)
            size *= 2
    return ahead, back


@dataclass
class Windows:
    """Windows of a slice: row, place in the row, code of both strands, and the two bits of the letters before and after (4: none)."""

    row: np.ndarray
    pos: np.ndarray
    code: np.ndarray
    rc: np.ndarray
    prev: np.ndarray
    next: np.ndarray


def windows(data: np.ndarray, off: np.ndarray, k: int, step: int = STEP) -> Iterator[Windows]:
    """The k-mers of all sequences in order, ``step`` at a time."""
    for a in range(0, max(len(data) - k + 1, 0), step):
        b = min(a + step, len(data) - k + 1)
        lo, hi = max(a - 1, 0), min(b + k, len(data))
        two = _TWO[data[lo:hi]]
        skip = a - lo
        ahead, back = window_codes(two[skip : skip + b - a + k - 1], k)
        r0, r1 = np.searchsorted(off, (a, b - 1), "right") - 1
        rows, n = np.arange(r0, r1 + 1), np.diff(np.clip(off[r0 : r1 + 2], a, b))
        before, after = np.full(b - a, 4, np.uint8), np.full(b - a, 4, np.uint8)
        before[1 - skip :] = two[: b - a - 1 + skip]
        after[: hi - a - k] = two[skip + k : skip + b - a + k]
        begins, ends = off[r0 : r1 + 1], off[r0 + 1 : r1 + 2]
        before[begins[(begins >= a) & (begins < b)] - a] = 4
        after[ends[(ends - k >= a) & (ends - k < b)] - k - a] = 4
        at = np.arange(a, b)
        fits = at + k <= np.repeat(ends, n)
        if (two == 255).any():
            bad = np.concatenate([[0], np.cumsum(two == 255)])
            fits &= bad[at + k - lo] == bad[at - lo]
            before, after = np.minimum(before, 4), np.minimum(after, 4)
        use = np.flatnonzero(fits)
        yield Windows(np.repeat(rows, n)[use], (at - np.repeat(begins, n))[use], ahead[use].astype(np.int64), back[use].astype(np.int64), before[use], after[use])


_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGT")] = list(b"TGCA")
_BIT = np.array([1, 2, 4, 8, 0], np.uint8)
_BIT_RC = np.array([8, 4, 2, 1, 0], np.uint8)  # of the complement


def masks(prev: np.ndarray, next: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight bits, the letter before (low four) and after, as seen on this strand and on the other."""
    return _BIT[prev] | _BIT[next] << 4, _BIT_RC[next] | _BIT_RC[prev] << 4


def combine(code: np.ndarray, rc: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each code once, with its reverse complement, the union of its masks and its number."""
    if not len(code):
        return code, rc, mask, np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    code, rc, mask = code[order], rc[order], mask[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], rc[first], np.bitwise_or.reduceat(mask, first), np.diff(np.append(first, len(code)))


def text_windows(data: np.ndarray, off: np.ndarray, k: int, letters: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """As ``windows``, for k-mers too long for a number: row, place, k-mer and reverse complement as text, letters before and after."""
    other = _COMPLEMENT[data][::-1]
    for w in windows(data, off, 1, max(letters // k, 1)):
        at = off[w.row] + w.pos
        bad = np.concatenate([[0], np.cumsum(_TWO[data[at[0] : at[-1] + k]] == 255)]) if len(at) else np.zeros(1, np.int64)
        use = np.flatnonzero(at + k <= off[w.row + 1])
        use = use[bad[at[use] + k - at[0]] == bad[at[use] - at[0]]] if len(use) else use
        at, row = at[use], w.row[use]
        after = np.where(at + k < off[row + 1], _TWO[data[np.minimum(at + k, len(data) - 1)]], 4)
        n = len(data)
        yield row, w.pos[use], cut(data, at, at + k), cut(other, n - at - k, n - at), w.prev[use], np.minimum(after, 4)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbouring values."""
    span = 1
    while span < w:
        step = min(span, w - span)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        span += step
    return x


def minimizers(data: np.ndarray, off: np.ndarray, k: int, w: int, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first window, smallest canonical code) of each ``w`` neighbouring k-mers, where it changes."""
    last = (-1, -1, -1)  # row, place and minimum of the window before
    kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    for x in windows(data, off, k, step):
        row, pos, low = (np.concatenate([a, b]) for a, b in zip(kept, (x.row, x.pos, np.minimum(x.code, x.rc)), strict=True))
        full = np.flatnonzero((row[: len(row) - w + 1] == row[w - 1 :]) & (pos[w - 1 :] - pos[: len(row) - w + 1] == w - 1)) if len(row) >= w else np.zeros(0, np.int64)
        least = sliding_min(low, w)[full]
        r, p = row[full], pos[full]
        if len(r):
            same = np.concatenate([[last == (r[0], p[0] - 1, least[0])], (r[1:] == r[:-1]) & (p[1:] == p[:-1] + 1) & (least[1:] == least[:-1])])
            last = (int(r[-1]), int(p[-1]), int(least[-1]))
            yield r[~same], p[~same], least[~same]
        kept = [a[len(a) - min(w - 1, len(a)) :] for a in (row, pos, low)]


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = end - start
    to = np.cumsum(size)
    at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start - (to - size), size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], to]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.string())


#: Four letters of a byte of two-bit letters.
QUADS = np.frombuffer(b"".join(bytes(b"ACGT"[i >> s & 3] for s in (6, 4, 2, 0)) for i in range(256)), np.uint32)


def letters(code: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` letters of each code, a row each."""
    words = -(-n // 4)
    x = code << 2 * (4 * words - n)
    out = np.empty((len(code), words), np.uint32)
    for j in range(words):
        out[:, j] = QUADS[x >> 8 * (words - 1 - j) & 255]
    return out.view(np.uint8)[:, :n]


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of letters as strings."""
    n, k = rows.shape
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(k)), pa.py_buffer(np.ascontiguousarray(rows))])


def run_starts(col: pa.Array) -> pa.Array:
    """0-based places at which a run of one letter begins, for each sequence."""
    data, off = buffers(col)
    new = np.ones(len(data), bool)
    new[1:] = data[1:] != data[:-1]
    new[off[:-1][off[:-1] < len(data)]] = True
    at = np.flatnonzero(new)
    row = np.searchsorted(off, at, "right") - 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(col)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((at - off[row]).astype(np.int32)), mask=col.is_null() if col.null_count else None)


def kmer_lists(col: pa.Array, k: int) -> pa.Array:
    """All substrings of ``k`` letters of each sequence, whatever its letters."""
    data, off = buffers(col)
    n = np.maximum(np.diff(off) - k + 1, 0)
    to = np.cumsum(n)
    at = np.arange(int(n.sum())) + np.repeat(off[:-1] - (to - n), n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), cut(data, at, at + k), mask=col.is_null() if col.null_count else None)
