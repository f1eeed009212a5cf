"""Benchmark decontamination: spaced-seed hashes and a substitution-tolerant check.

Texts are sequences of lower-cased words (runs of letters, marks and digits of any
script; each character of a script without spaces is a word). A seed is
a fixed mask over neighbouring words that ignores some positions; equal masked
words of a benchmark item and a document give a hit and with it an alignment. An
alignment overlaps if some window of ``WINDOW`` words agrees in all but two of them,
or, with an item shorter than that, a window of the item's length in all but one. The masks are such that every window that passes holds a hit, so the
result is what trying all alignments would give.

The documents are read once for each block of the benchmark, without a shuffle;
a block's hashes are sent to the executors and have at most ``block_words`` words
(expected; items are dealt to blocks by hash). Blocks are searched one after the
other and freed, so a larger benchmark means more passes and not more memory.

Items of fewer than ``MIN_ITEM`` words are searched with ``short=True``, by an exact
match of all their words (a hash of the whole item), and else not at all.

Edge cases: an item without words overlaps nothing; null or empty texts overlap nothing; null item texts are
skipped; repeated documents or items give repeated overlaps; of equal overlaps with an
item the first in the document is reported; a very long text is searched whole, and one
of few different words costs n log n; a null doc_id is searched and reported as null;
empty tables give no overlaps; extra columns are ignored or, by ``clean``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm.common import project
from strandloom.plans import scratch

WINDOW, MIN_ITEM = 13, 8
#: Word offsets that each seed looks at. Together they hit every window that passes the check (tested for all).
SEEDS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 3, 4, 6))
BLOCK_WORDS = 2_000_000
_BITS = 22
#: Pairs of places from which on their differences come from a convolution, and cells of alignments compared at once.
DENSE, CELLS = 1 << 12, 1 << 20
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_Q = [np.uint64(x) for x in K.mix64(np.arange(8, dtype=np.uint64) + np.uint64(909)) | np.uint64(1)]
#: Outside ASCII: what belongs to no word, and the characters that are words of their own.
_OTHER_GAP = r"[^\x00-\x7F\p{L}\p{N}\p{M}]+"
_ALONE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_ALONE_JAVA = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
OVERLAP = "array<struct<item_id:bigint,n_words:bigint,n_equal:bigint,doc_from:bigint,item_from:bigint>>"


def allowed(width: int) -> int:
    """Substitutions that a window of so many words may have."""
    return 2 if width >= WINDOW else 1 if width >= MIN_ITEM else 0


def text_words(col: pa.Array) -> K.Spans:
    col = pc.utf8_lower(col)
    lead = K.buffers(col)[0].max(initial=0)
    if lead >= 0xC2:  # not ASCII alone
        col = pc.replace_substring_regex(col, _OTHER_GAP, " ")
    if lead >= 0xE0:  # the scripts without spaces have three bytes or more
        col = pc.replace_substring_regex(col, _ALONE, r" \1 ")
    return K.words(*K.buffers(col), _GAP)


def seed_keys(spans: K.Spans) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, first word) of every placement of each seed within a row."""
    n = len(spans.hash)
    for k, seed in enumerate(SEEDS):
        m = n - seed[-1]
        if m <= 0:
            continue
        h = np.full(m, k, np.uint64)
        for o in seed:
            h += spans.hash[o : o + m] * _Q[o]
        at = np.flatnonzero(spans.row[:m] == spans.row[seed[-1] :])
        yield K.mix64(h[at]), at


def whole_keys(spans: K.Spans, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, first word) of all runs of ``m`` words within a row."""
    n = len(spans.hash) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, len(SEEDS) + m, np.uint64)
    for o in range(m):
        h += spans.hash[o : o + n] * _Q[o]
    at = np.flatnonzero(spans.row[:n] == spans.row[m - 1 :])
    return K.mix64(h[at]), at


class Block:
    """The searched form of some benchmark items."""

    def __init__(self, ids: list[int], texts: pa.Array, short: bool = False) -> None:
        spans = text_words(texts)
        self.ids, self.hash, self.first = np.array(ids, np.int64), spans.hash, spans.row_starts()
        key = [np.zeros(0, np.uint64)]
        word = [np.zeros(0, np.int64)]
        long = np.diff(self.first) >= MIN_ITEM
        for k, at in seed_keys(spans):
            use = long[spans.row[at]]
            key.append(k[use])
            word.append(at[use])
        key, word = np.concatenate(key), np.concatenate(word)
        order = np.argsort(key, kind="stable")
        self.key, self.word = key[order], word[order]
        self.row = spans.row
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.key >> np.uint64(64 - _BITS)] = True
        #: By number of words: keys and first words of the short items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n_words = np.diff(self.first)
        for m in range(1, MIN_ITEM) if short else ():
            key, at = whole_keys(spans, m)
            use = n_words[spans.row[at]] == m
            if use.any():
                order = np.argsort(key[use], kind="stable")
                self.short[m] = key[use][order], at[use][order]
                self.seen[self.short[m][0] >> np.uint64(64 - _BITS)] = True

    def find(self, spans: K.Spans) -> list[list[dict]]:
        """Best overlap with each item, for each row of the slice."""
        out: list[list[dict]] = [[] for _ in range(spans.n_rows)]
        if not len(self.key) and not self.short:
            return out
        starts, shifts = spans.row_starts(), [np.zeros((0, 3), np.int64)]
        for key, at in seed_keys(spans) if len(self.key) else ():
            shifts.append(self._hits(spans, starts, key, at, self.key, self.word))
        for m, held in self.short.items():
            hits = self._hits(spans, starts, *whole_keys(spans, m), *held, first=True)
            shifts.append(hits)
        found = np.concatenate(shifts)
        found = found[np.lexsort(found.T[::-1])]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]).any(1)
        found = found[new]
        cut = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])) if len(found) else []
        for lo, hi in zip(cut, [*cut[1:], len(found)]):
            row, item = int(found[lo, 0]), int(found[lo, 1])
            if got := self._check(spans.hash[starts[row] : starts[row + 1]], item, found[lo:hi, 2]):
                out[row].append(got)
        return out

    def _hits(self, spans: K.Spans, starts: np.ndarray, key: np.ndarray, at: np.ndarray, keys: np.ndarray, words: np.ndarray, first: bool = False) -> np.ndarray:
        """Distinct (row, item, shift) of the placements whose key is among ``keys``; ``first``: of each (row, item) its first one.

        Placements and words are taken together by (row, key) and (key, item). Where
        both sides of such a pair have many places, as in text with a short period,
        the differences of the places come from one convolution instead of all pairs.
        """
        none = np.zeros((0, 3), np.int64)
        maybe = np.flatnonzero(self.seen[key >> np.uint64(64 - _BITS)])
        lo, hi = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], "right")
        maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(maybe):
            return none
        row = spans.row[at[maybe]]
        if first:
            keep = np.unique(np.stack([row, lo], 1), axis=0, return_index=True)[1]
            maybe, row, lo, hi = maybe[keep], row[keep], lo[keep], hi[keep]
        group, size = np.unique(np.stack([row, lo, hi], 1), axis=0, return_inverse=True, return_counts=True)[1:]
        size = size[group.reshape(-1)]
        dense = (size > 32) & (size * (hi - lo) > DENSE)
        pairs = none
        if len(few := np.flatnonzero(~dense)):
            n = (hi - lo)[few]
            mine = np.repeat(at[maybe[few]], n)
            theirs = words[np.repeat(lo[few] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            item = self.row[theirs]
            pairs = np.stack([spans.row[mine], item, (mine - starts[spans.row[mine]]) - (theirs - self.first[item])], 1)
        made = [pairs]
        for g in np.unique(group.reshape(-1)[dense]):
            mine = np.flatnonzero((group.reshape(-1) == g) & dense)
            r = int(row[mine[0]])
            theirs = words[lo[mine[0]] : hi[mine[0]]]
            place = at[maybe[mine]] - starts[r]
            theirs = theirs[np.argsort(self.row[theirs], kind="stable")]
            for part in np.split(theirs, np.flatnonzero(np.diff(self.row[theirs])) + 1):
                item = int(self.row[part[0]])
                other = part - self.first[item]
                shifts = differences(place, other) if len(place) * len(part) > DENSE else np.unique(place[:, None] - other)
                made.append(np.stack([np.full(len(shifts), r), np.full(len(shifts), item), shifts], 1))
        return np.concatenate(made)

    def _check(self, doc: np.ndarray, item: int, shifts: np.ndarray) -> dict | None:
        """The best overlap over the alignments where item word i meets document word i + shift: most equal words, then the first in the document."""
        words = self.hash[self.first[item] : self.first[item + 1]]
        m = len(words)
        width = min(WINDOW, m)
        best: tuple | None = None
        step = max(1, CELLS // (m + 1))
        for k in range(0, len(shifts), step):
            at = shifts[k : k + step, None] + np.arange(m)
            inside = (at >= 0) & (at < len(doc))
            same = inside & (doc[np.clip(at, 0, len(doc) - 1)] == words)
            equal = np.zeros((len(at), m + 1), np.int32)
            np.cumsum(same, axis=1, out=equal[:, 1:])
            reach = np.zeros((len(at), m + 1), np.int32)
            np.cumsum(inside, axis=1, out=reach[:, 1:])
            good = (equal[:, width:] - equal[:, :-width] >= width - allowed(width)) & (reach[:, width:] - reach[:, :-width] == width)
            for i in np.flatnonzero(good.any(1)):
                a = int(good[i].argmax())
                b = m + 1 - width - int(good[i][::-1].argmax()) - 1 + width
                n, start = int(equal[i, b] - equal[i, a]), a + int(shifts[k + i])
                if best is None or (n, -start) > (best[0], -best[2]):
                    best = n, b - a, start, a
        return best and {"item_id": int(self.ids[item]), "n_words": best[1], "n_equal": best[0], "doc_from": best[2], "item_from": best[3]}


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All different values of x - y, by a convolution of the two sets."""
    low, high = int(a.min()), int(b.max())
    n = int(a.max()) - low + high - int(b.min()) + 1
    size = 1 << (n - 1).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[a - low], y[high - b] = 1, 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[:n] > 0.5) + low - high


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, short: bool = False) -> Iterator[tuple[Block, bool]]:
    """The benchmark in blocks of about ``block_words`` words at most, and whether a block is the last."""
    items = project(benchmark, "item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").withColumn("item_id", F.col("item_id").cast("long"))
    total = items.agg(F.sum(F.length("text") / 5 + F.regexp_count("text", F.lit(_ALONE_JAVA)))).first()[0] or 0
    n = max(1, -int(-total // block_words))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        got = part.toArrow().combine_chunks().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Block(got.column("item_id").to_pylist(), got.column("text").combine_chunks(), short), k == n - 1


def _search(sent: Broadcast):
    """The overlaps of a text column with a block, as an array column."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "n_words", "n_equal", "doc_from", "item_from")]))

    @F.arrow_udf(OVERLAP)
    @K.lean
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            out: list[list[dict]] = []
            for part in K.slices(pa.RecordBatch.from_arrays([col], names=["text"]), "text"):
                out += sent.value.find(text_words(K.column(part, "text")))
            yield pa.array(out, kind)

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, short: bool = False) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, n_words, n_equal, doc_from, item_from.

    One block is searched when the result is read; with more, each block's rows are
    written before the next block is made, so one block is in memory at a time.
    """
    done: DataFrame | None = None
    sc, texts = docs.sparkSession.sparkContext, project(docs, "doc_id", "text")
    for block, last in blocks(benchmark, block_words, short):
        sent = sc.broadcast(block)  # about block_words words
        rows = texts.select("doc_id", F.explode(_search(sent)(F.col("text"))).alias("o")).select("doc_id", "o.*")
        if last and done is None:
            return rows
        rows = scratch.cut(rows, "overlaps")
        sent.destroy()
        done = rows if done is None else done.unionByName(rows)
    return done


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, short: bool = False) -> DataFrame:
    """The documents that overlap no benchmark item, all columns; a block sees what the ones before it left."""
    sc = docs.sparkSession.sparkContext
    for block, last in blocks(benchmark, block_words, short):
        sent = sc.broadcast(block)
        docs = docs.withColumn("__overlaps", _search(sent)(F.col("text"))).filter(F.size("__overlaps") == 0).drop("__overlaps")
        if not last:
            docs = scratch.cut(docs, "clean")
            sent.destroy()
    return docs
