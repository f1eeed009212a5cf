"""Substring deduplication: content-defined chunks of a gear rolling hash.

The gear hash of a position adds the random 32-bit codes of the last sixteen
bytes, each shifted by its distance. A chunk ends where that hash is smaller than
at the ``reach`` positions on both sides. Minima that tie, as in text with a short
period, end chunks at the first and the last of their run and, between them, at
each next one that is out of reach of the end before. The rule looks at nothing but
nearby bytes: an insertion moves later boundaries along with their text, and a
passage has the same chunks inside wherever it stands, save those in which it or a
run begins or ends. Only the last chunk of such a run and those at a text's end can be
shorter than ``reach + 1`` bytes. Chunks are deduplicated by a 128-bit digest.

A chunk is repeated if two different documents hold it. Runs of neighbouring
repeated chunks of at least ``min_bytes`` are reported as passages, so a short
phrase that recurs by chance is not one. A passage's chunks belong to the smallest
``doc_id`` that holds them; ``dedup_text`` removes them elsewhere.

Digests are counted by their smallest and largest document, with partial sums
before the shuffle, and chunks meet the repeated digests in a join that only
Spark's exchanges deal out, so a passage in a third of all documents is split at
run time. Runs are found by document, among its repeated chunks only.

Edge cases: null and empty texts have no chunks; a null doc_id is left out; a
chunk that only recurs within one document is not repeated; rows that repeat a
doc_id count as one document, and their passages appear once for each different
place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm.common import project

REACH, MIN_BYTES = 12, 80
_GEAR = (K.CODES >> np.uint64(16)).astype(np.uint32)
_CHUNKS = "doc_id long, first long, last long, hi long, lo long"


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash over the last sixteen bytes at each position, by doubling."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8):
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
    return h


def chunk_ends(data: np.ndarray, off: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of all chunks of a slice."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    h = gear(data)
    top = np.full(reach, np.iinfo(np.uint32).max, np.uint32)
    wide = np.concatenate([top, h, top])
    low = wide
    span = 1
    while span < reach:  # minima over windows of ``reach`` positions, by doubling
        step = min(span, reach - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    before, after = low[:n], low[reach + 1 : reach + 1 + n]
    end = _thinned((h <= before) & (h <= after), reach)
    end[:-1] &= (data[1:] & 0xC0) != 0x80  # never inside a code point
    # positions near a row's ends see other rows' bytes: they end no chunk
    edge = np.zeros(n + 1, np.int64)
    margin = reach + 16
    np.add.at(edge, np.maximum(off - margin, 0), 1)
    np.add.at(edge, np.minimum(off + margin, n), -1)
    end &= np.cumsum(edge[:-1]) == 0
    cut = np.union1d(np.flatnonzero(end) + 1, off)
    start, stop = cut[:-1], cut[1:]
    return start, stop, np.searchsorted(off, start, "right") - 1


def _thinned(weak: np.ndarray, reach: int) -> np.ndarray:
    """Of the minima that tie with others in reach: the first, the last and, between them, each next one that is out of reach."""
    at = np.flatnonzero(weak)
    near = np.diff(at) <= reach
    tied = np.flatnonzero(near & ~np.concatenate([[False], near[:-1]])) if len(near) else near
    if not len(tied):
        return weak
    ends = np.flatnonzero(np.concatenate([near, [False]]) < np.concatenate([[False], near]))
    far = np.searchsorted(at, at + reach, "right")
    keep = np.ones(len(at), bool)
    for a, b in zip(tied.tolist(), ends.tolist(), strict=True):
        keep[a + 1 : b] = False
        k = int(far[a])
        while k < b:
            keep[k] = True
            k = int(far[k])
    out = np.zeros(len(weak), bool)
    out[at[keep]] = True
    return out


def chunks(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """All chunks: doc_id, byte range in the text, 128-bit digest."""

    @K.lean
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                data, off = K.buffers(K.column(part, "text"))
                start, end, row = chunk_ends(data, off, reach)
                doc = part.column(0).to_numpy(zero_copy_only=False)[row]
                digest = [pa.array(K.signed(h)) for h in K.span_hash(data, start, end, 0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(start - off[row]), pa.array(end - off[row]), *digest],
                    names=[x.split()[0] for x in _CHUNKS.split(", ")],
                )

    return project(docs, "doc_id", "text").filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scan, _CHUNKS)


def passages(docs: DataFrame, reach: int = REACH, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Repeated passages: doc_id, first and last byte, n_chunks, keeper (the smallest of the chunks' keepers), and lost, the chunks that another document keeps."""
    table = chunks(docs, reach)  # cut twice, for the counts and for the join, and not written: less disk
    repeated = table.groupBy("hi", "lo").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("__other")).filter("keeper < __other").drop("__other")
    placed = table.select("doc_id", (F.shiftleft("first", 32) + F.col("last") - F.col("first")).alias("place"), "hi", "lo")  # one number: less to shuffle
    # dealt by document once: the distinct places and the runs need no exchange of their own
    held = placed.join(repeated, ["hi", "lo"]).select("doc_id", "place", "keeper").repartition("doc_id").distinct()
    first = F.shiftright("place", 32)
    held = held.select("doc_id", first.alias("first"), (first + F.col("place").bitwiseAND((1 << 32) - 1)).alias("last"), "keeper")
    order = Window.partitionBy("doc_id").orderBy("first", "last")
    breaks = held.withColumn("__new", F.when(F.lag("last").over(order) == F.col("first"), 0).otherwise(1))
    runs = breaks.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("doc_id", "__run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n_chunks"), F.min("keeper").alias("keeper"), F.sort_array(F.collect_list(F.when(F.col("keeper") < F.col("doc_id"), F.struct("first", "last")))).alias("lost"))
        .filter(F.col("last") - F.col("first") >= min_bytes)
        .drop("__run")
    )


def dedup_text(docs: DataFrame, reach: int = REACH, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` without the passages that a document with a smaller doc_id keeps."""
    lost = passages(docs, reach, min_bytes).filter("keeper < doc_id").groupBy(F.col("doc_id").alias("__doc")).agg(F.sort_array(F.flatten(F.collect_list("lost"))).alias("__lost"))
    both = docs.join(lost, docs["doc_id"].cast("long") == F.col("__doc"), "left")

    @F.arrow_udf("string")
    def without(texts: pa.Array, lost: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), lost.to_pylist(), strict=True):
            raw, at, kept = (text or "").encode(), 0, []
            for s in spans or []:
                kept.append(raw[at : s["first"]])
                at = max(at, s["last"])
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    touched = F.col("__lost").isNotNull()
    return both.withColumn("text", F.when(touched, without(F.when(touched, F.col("text")), F.col("__lost"))).otherwise(F.col("text"))).drop("__doc", "__lost")
