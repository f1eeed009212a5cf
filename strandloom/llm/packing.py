"""Packing: cutting-stock column generation over the histogram of piece lengths.

A document's tokens (its ids and an end mark) are cut by its length alone: full
pieces of ``capacity``, then a body that is a multiple of ``UNIT`` and a tail
shorter than ``UNIT``. So there are about a hundred piece lengths whatever the
corpus, and the histogram over them is all that the driver sees. On it a linear
program over patterns (multisets of lengths that fit one sequence) minimises the
number of sequences; its columns are generated by an unbounded knapsack (dynamic
programming over the capacity) on the dual prices. The patterns' rounded-down
counts are laid out first, and the few pieces that rounding leaves (fewer than a
sequence for each pattern) are packed by best fit on their counts.

A piece's place follows from its length and its rank among the pieces of that
length. Ranks need no sort of the table: each task of the tokenising pass numbers
its pieces by length, and a running sum over (task, length) counts lifts that to
a global rank. Texts and ids never move; only the pieces' small rows do.

Edge cases: a null or empty text is one piece with the end mark; a null doc_id
stays null; a very long text is tokenised by itself, whole; repeated rows of a
doc_id are packed row by row; an empty table gives no pieces; extra columns are
ignored. Lengths that tie are laid out by task and by order of reading, so another
partitioning of the same table may place a piece elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import byte_pairs
from strandloom.llm import kernels as K
from strandloom.llm.common import project
from strandloom.plans import scratch

CAPACITY, UNIT, END_ID = 2048, 32, 1
#: Bytes of text whose distinct words are merged together, or one document's if it is longer.
SLICE_BYTES = 1 << 20
_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, task int, local long"


# --- the linear program ---------------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity of the highest price, by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, y = sizes[order], price[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            v = best[c - s[:k]] + y[:k]
            at = int(v.argmax())
            if v[at] > best[c] + 1e-12:
                best[c], choice[c] = v[at], at
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[order[choice[c]]] += 1
            c -= int(s[choice[c]])
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts of the linear program ``min sum(x), A x = demand``."""
    basis = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = best_pattern(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x = np.maximum(x - t * step, 0)
        x[out] = t
        basis[:, out] = pattern
    return np.rint(basis).astype(np.int64), x


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, copies a sequence, first sequence, offset).

    A rank from ``first rank`` on is copy ``(rank - first) % copies`` in sequence
    ``first sequence + (rank - first) // copies``. Sorted by length and rank.
    """
    demand = {int(s): int(n) for s, n in histogram.items() if n}
    used = dict.fromkeys(demand, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    seq = 0

    def lay(pattern: list[tuple[int, int]], times: int) -> None:
        nonlocal seq
        at = 0
        for s, copies in pattern:
            rows.append((s, used[s], copies, seq, at))
            used[s] += copies * times
            at += copies * s
        seq += times

    if capacity in demand:
        lay([(capacity, 1)], demand[capacity])
    sizes = np.array(sorted((s for s in demand if s != capacity), reverse=True), np.int64)
    if len(sizes):
        patterns, x = cutting_stock(sizes, np.array([demand[s] for s in sizes], float), capacity)
        for j in np.argsort(-x, kind="stable"):
            pattern = [(int(s), int(k)) for s, k in zip(sizes, patterns[:, j], strict=True) if k]
            times = min([int(x[j] + 1e-6), *((demand[s] - used[s]) // k for s, k in pattern)])
            if times > 0:
                lay(pattern, times)
        bins: list[list[int]] = []
        room: list[int] = []
        for s in map(int, sizes):
            for _ in range(demand[s] - used[s]):
                fit = [(r, i) for i, r in enumerate(room) if r >= s]
                i = min(fit)[1] if fit else len(bins)
                if not fit:
                    bins.append([])
                    room.append(capacity)
                bins[i].append(s)
                room[i] -= s
        for pieces in bins:
            lay([(s, pieces.count(s)) for s in sorted(set(pieces), reverse=True)], 1)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# --- tokens and pieces ----------------------------------------------------------------------------


def cut_points(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[int]:
    """Lengths of a document's pieces."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [x for x in (rest - rest % unit, rest % unit) if x]


def _cut(n: np.ndarray, capacity: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and length of all pieces of documents of ``n`` tokens, as ``cut_points`` has them."""
    full, rest = n // capacity, n % capacity
    body, tail = rest - rest % unit, rest % unit
    doc = np.repeat(np.arange(len(n)), full + 2)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(full + 2) - (full + 2), full + 2)
    size = np.where(place < full[doc], capacity, np.where(place == full[doc], body[doc], tail[doc]))
    some = size > 0
    return doc[some], size[some]


def _numbered(size: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's number among those of its length; ``seen`` counts by length and goes on."""
    order = np.argsort(size, kind="stable")
    s = size[order]
    local = np.empty(len(size), np.int64)
    local[order] = np.arange(len(s)) - np.searchsorted(s, s) + seen[s]
    np.add.at(seen, size, 1)
    return local


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their ids (binary, little-endian 32 bits), numbered by task and length."""

    @K.lean
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs.load(tokenizer_path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                ids, n = pairs.of_slice(*K.buffers(K.column(part, "text")))
                every = np.full(len(ids) + len(n), end_id, "<u4")
                every[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n = n + 1
                doc, size = _cut(n, capacity, unit)
                end = np.cumsum(size)
                start = end - size - (np.cumsum(n) - n)[doc]
                held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], end * 4]).astype(np.int32)), pa.py_buffer(every)])
                cols = [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(n[doc]), held, pa.array(np.full(len(size), task, np.int32)), pa.array(_numbered(size, seen))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _PIECES.split(", ")])

    return project(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scan, _PIECES)


def pack(docs: DataFrame, tokenizer_path: str, payload: Mapping[str, Column] | None = None, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset and the payload.

    ``payload``: columns made from the pieces (``ids`` among their columns) and
    carried along; the ids themselves if not given.
    """
    spark = docs.sparkSession
    made = pieces(docs, tokenizer_path, capacity, unit, end_id)
    kept = payload if payload is not None else {"ids": F.col("ids")}
    table = scratch.cut(made.select("doc_id", "start", "length", "doc_tokens", "task", "local", *[c.alias(k) for k, c in kept.items()]), "pieces")
    counts = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many rows as lengths
    places = plan(histogram, capacity)  # some thousand rows at most, by the number of lengths

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        p = places
        s, r = length.to_numpy(), rank.to_numpy()
        wide = int(p[:, 1].max(initial=0)) + 1
        wide = max(wide, int(r.max(initial=0)) + 1)
        row = p[np.searchsorted(p[:, 0] * wide + p[:, 1], s * wide + r, "right") - 1]
        k = r - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * s)], ["sequence_id", "offset"])

    ranked = table.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])
    placed = ranked.withColumn("__place", place(F.col("length"), F.col("local") + F.col("before")))
    return placed.select("doc_id", "start", "length", "doc_tokens", "__place.sequence_id", "__place.offset", *kept)
