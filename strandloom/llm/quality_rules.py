"""Quality rules: document measures and cross-document line frequency within a host.

Pass 1 reads each whole text once and yields the document's measures and, for
each distinct normalised line, a 64-bit hash and the words on such lines. Lines
are then counted by the distinct documents of a host that hold them. A line over
the host's limit (more than ``min_docs`` documents, and more than ``per_mille`` in
a thousand of the host's) is removed from all its documents, and a document of
which less than ``min_left`` percent of the words remain is depleted and rejected.
``judge`` gives the verdicts, ``remove_lines`` the texts without such lines.

Normalised line: white space stripped at both ends, runs of digits as one ``0``,
A-Z in lower case. Lines without a word are never counted.

Copies of a text on a host have the same lines, so their documents are counted
first and each text's lines go on once, with that number. Counting is by (host, line
hash) with partial sums before the shuffle, so a hot host or a line in every document
arrives as one row from each task. Removed
words are found by joining each document's lines with the frequent ones; only
Spark's own exchanges deal out that join, so skewed keys are split at run time.

Edge cases: a null text has no words and fails the base rules; a null host is a
host of its own; rows that repeat a ``doc_id`` are judged by their own text and, if
the texts are equal, counted once (with another text, as another document); a null
``doc_id`` is judged but not counted, and keeps its lines; a line exactly at a limit
stays; very long texts are read whole; an empty table gives an empty result; extra
columns are ignored, by ``remove_lines`` kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm.common import project
from strandloom.plans import scratch

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line is frequent on a host over this many distinct documents ...
MIN_DOCS = 20
#: ... and over this many in a thousand of the host's documents.
PER_MILLE = 10
MIN_LEFT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PROFILE = "doc_id long, host long, print_hi long, print_lo long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<long>"


def repeat_words(spans: K.Spans, size: int) -> np.ndarray:
    """Per row: words in windows of ``size`` words that the row holds twice or more."""
    h, at = K.windows(spans, size)
    again = at[K.repeated(h ^ K.mix64(spans.row[at].astype(np.uint64)))]
    cover = np.zeros(len(spans.hash) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + size, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(spans.row[inside], minlength=spans.n_rows)


def _normal(data: np.ndarray) -> np.ndarray:
    """Lower case, each digit as 0."""
    return np.where(_DIGIT[data], np.uint8(48), K.ASCII_LOWER[data])


def _squeeze(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with runs of zeros made one; offsets follow."""
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 48) | (data[:-1] != 48)
    keep[off[:-1][off[:-1] < len(data)]] = True
    new = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], new[off]


def profile_slice(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of each row, and its distinct normalised lines with their words."""
    rows = len(off) - 1
    spans = K.words(data, off)
    per_row = spans.per_row()
    chars = np.bincount(spans.row, K.code_points(data, spans.start, spans.end), rows).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    start, end, row = K.lines(data, off)
    held = np.searchsorted(spans.start, end) - np.searchsorted(spans.start, start)  # words on the line
    solid = held > 0
    raw = K.span_hash(data, start, end) ^ K.mix64(row.astype(np.uint64))
    dup = np.zeros(len(start), bool)
    dup[solid] = K.later(raw[solid])
    low, low_off = _squeeze(_normal(data), off)
    ls, le, lrow = K.lines(low, low_off)
    s, e = K.strip(low, ls, le)
    h = K.span_hash(low, s, e)[solid]
    lrow, held = lrow[solid], held[solid]
    order = np.lexsort((h, lrow))
    h, lrow, held = h[order], lrow[order], held[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (lrow[1:] != lrow[:-1])
    at = np.flatnonzero(new)
    print_hi, print_lo = K.span_hash(data, off[:-1], off[1:], 0, 1)
    return {
        "print_hi": print_hi, "print_lo": print_lo, "n_words": per_row, "word_chars": chars,
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]], "n_dup_lines": np.bincount(row[dup], minlength=rows), "n_repeat_words": repeat_words(spans, WINDOW),
        "line_hash": h[at], "line_words": np.add.reduceat(held, at) if len(at) else held, "line_off": np.concatenate([[0], np.cumsum(np.bincount(lrow[at], minlength=rows))]),
    }


def profiles(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row for each row of ``docs``: its measures and its distinct lines."""

    @K.lean
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                m = profile_slice(*K.buffers(K.column(part, "text")))
                at = pa.array(m["line_off"].astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (K.signed(m["line_hash"]), m["line_words"].astype(np.int64))]
                longs = [K.signed(m["print_hi"]), K.signed(m["print_lo"])] + [m[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, longs), *lists], names=[x.split()[0] for x in _PROFILE.split(", ")])

    rows = project(docs, "doc_id", host, "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{host}`").cast("string")).alias("host"), "text")
    return rows.mapInArrow(scan, _PROFILE)


TEXT_KEY = ["host", "print_hi", "print_lo"]


def frequent_lines(table: DataFrame, min_docs: int = MIN_DOCS, per_mille: int = PER_MILLE) -> tuple[DataFrame, DataFrame]:
    """Each text's lines (host, print_hi, print_lo, line_hash, line_words), and the frequent ones (host, line_hash), of written ``profiles``."""
    texts = table.groupBy(*TEXT_KEY).agg(F.first("line_hash").alias("line_hash"), F.first("line_words").alias("line_words"))
    held = table.select(*TEXT_KEY, "doc_id").distinct().groupBy(*TEXT_KEY).agg(F.count("doc_id").alias("n_docs"))
    sizes = held.groupBy("host").agg(F.sum("n_docs").alias("host_docs"))
    lines = texts.join(held, TEXT_KEY).select(*TEXT_KEY, "n_docs", F.explode(F.arrays_zip("line_hash", "line_words")).alias("line")).select(*TEXT_KEY, "n_docs", "line.line_hash", "line.line_words")
    counted = lines.groupBy("host", "line_hash").agg(F.sum("n_docs").alias("n")).filter(F.col("n") > min_docs)
    frequent = counted.join(sizes, "host").filter(F.col("n") * 1000 > F.col("host_docs") * per_mille).select("host", "line_hash")
    return lines.drop("n_docs"), frequent


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, per_mille: int = PER_MILLE, min_left: int = MIN_LEFT_PERCENT) -> DataFrame:
    """doc_id, the measures, base_failed, n_frequent_words, depleted and kept for each row of ``docs``.

    A document's rows are told apart by their text's fingerprint, so rows that
    repeat a ``doc_id`` get the verdict of their own text.
    """
    table = scratch.cut(profiles(docs, host), "line-profiles")
    lines, frequent = frequent_lines(table, min_docs, per_mille)
    removed = lines.join(frequent, ["host", "line_hash"]).groupBy(*TEXT_KEY).agg(F.sum("line_words").alias("n_frequent_words"))
    n, gone = F.col("n_words"), F.col("n_frequent_words")
    return (
        table.drop("line_hash", "line_words")
        .join(removed, TEXT_KEY, "left")
        .withColumn("n_frequent_words", F.coalesce(gone, F.lit(0)).cast("long"))
        .withColumn("base_failed", (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT))
        .withColumn("depleted", (n - gone) * 100 < n * min_left)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop(*TEXT_KEY)
    )


def remove_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, per_mille: int = PER_MILLE) -> DataFrame:
    """``docs`` with the frequent lines of their host taken out of ``text``; all columns stay, and no document goes."""
    table = scratch.cut(profiles(docs, host), "line-profiles")
    lines, frequent = frequent_lines(table, min_docs, per_mille)
    by_text = lines.join(frequent, ["host", "line_hash"]).select(*TEXT_KEY, "line_hash").distinct()
    ids = table.filter("doc_id IS NOT NULL").select("doc_id", *TEXT_KEY).distinct()
    lost = ids.join(by_text, TEXT_KEY).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line_hash").alias("__lost"))

    @F.arrow_udf("string")
    def without(texts: pa.Array, lost: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), lost.to_pylist(), strict=True):
            raw = (text or "").encode()
            data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
            low, low_off = _squeeze(_normal(data), off)
            ls, le, _ = K.lines(low, low_off)
            hashes = K.signed(K.span_hash(low, *K.strip(low, ls, le)))
            start, end, _ = K.lines(data, off)
            stay = ~np.isin(hashes, np.array(gone or [], np.int64))
            out.append(b"\n".join(raw[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True)).decode())
        return pa.array(out, pa.string())

    touched = F.col("__lost").isNotNull()
    both = docs.join(lost, docs["doc_id"].cast("long") == F.col("__doc"), "left")
    return both.withColumn("text", F.when(touched, without(F.when(touched, F.col("text")), F.col("__lost"))).otherwise(F.col("text"))).drop("__doc", "__lost")
