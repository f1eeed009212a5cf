"""Quality: a generalised additive model with pairwise interactions.

Sixteen measures of a text (shape, characters, repetition) are cut into quantile
bins. Boosted trees with at most three leaves visit the features in turn, one
feature a tree, and add to that feature's lookup table; then pairs of features
that still explain the residual best get two-dimensional tables from depth-two
trees, again in turn. A score is the logistic of the sum of the tables' entries
at the text's bins: vectorised additions, no tree is walked.

The measures of at most ``max_train_docs`` labelled documents (a hash sample
beyond that, whole texts) are computed on the executors; the fit itself sees
sixteen numbers a document and runs on the driver. The model is a few thousand
numbers. Scoring is one pass without a shuffle.

Edge cases: a null or empty text has all measures zero and is scored from them;
without usable labels every score is 0.5; null labels are ignored; rows that
repeat a doc_id are scored by their own text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm.common import hash_sample, project
from strandloom.llm.quality_rules import SYMBOLS, repeat_words

#: Labelled documents read for the fit at most.
MAX_TRAIN_DOCS = 12_000
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.1, 1.0
FEATURES = (
    "log_words", "word_length", "symbols", "digits", "upper", "punctuation", "log_words_a_line", "repeated_lines",
    "repeated_windows", "distinct_words", "lines_ended", "non_ascii", "exclamations", "log_longest_word", "repeated_pairs", "short_words",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_DIGIT, _SYMBOL, _BANG = _table(b"0123456789"), _table(SYMBOLS), _table(b"!")
_PUNCT, _STOP = _table(b".,;:!?'\"()-"), _table(b".!?:;\"")
_WIDE = np.arange(256) >= 128


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice."""
    rows = len(off) - 1
    spans = K.words(data, off)
    n = spans.per_row().astype(float)
    some = np.maximum(n, 1)

    def share(t: np.ndarray) -> np.ndarray:
        pre = np.concatenate([[0], np.cumsum(t[data])])
        return (pre[off[1:]] - pre[off[:-1]]).astype(float)

    length = K.code_points(data, spans.start, spans.end)
    chars = np.maximum(np.bincount(spans.row, length, rows), 1)
    longest = np.zeros(rows)
    np.maximum.at(longest, spans.row, length)
    upper, lower = share(_UPPER), share(_LOWER)
    start, end, row = K.lines(data, off)
    s, e = K.strip(data, start, end)
    solid = np.flatnonzero(e > s)
    row_salt = K.mix64(np.arange(rows, dtype=np.uint64))
    n_lines = np.maximum(np.bincount(row[solid], minlength=rows), 1)
    again = K.later(K.span_hash(data, s[solid], e[solid]) ^ row_salt[row[solid]])
    ended = _STOP[data[e[solid] - 1]]
    first = ~K.later(spans.hash ^ row_salt[spans.row])
    return np.stack([
        np.log1p(n), chars / some, share(_SYMBOL) / chars, share(_DIGIT) / chars, upper / np.maximum(upper + lower, 1), share(_PUNCT) / chars,
        np.log1p(n / n_lines), np.bincount(row[solid][again], minlength=rows) / n_lines, repeat_words(spans, 8) / some, np.bincount(spans.row[first], minlength=rows) / some,
        np.bincount(row[solid][ended], minlength=rows) / n_lines, share(_WIDE) / np.maximum(np.diff(off), 1), share(_BANG) / chars, np.log1p(longest), repeat_words(spans, 2) / some,
        np.bincount(spans.row[length <= 3], minlength=rows) / some,
    ], axis=1)


@dataclass
class AdditiveModel:
    """Cut points and lookup tables: the score is logistic(bias + sum of entries)."""

    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], "right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut_once(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best cut of the bins [lo, hi) in two: (gain, position)."""
    if hi - lo < 2:
        return 0.0, hi
    a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    tg, th = g[lo:hi].sum(), h[lo:hi].sum()
    gain = _gain(a, b) + _gain(tg - a, th - b) - _gain(tg, th)
    k = int(gain.argmax())
    return float(gain[k]), lo + 1 + k


def _three_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most three leaves over one feature's bins, as a table."""
    n = len(g)
    gain, at = _cut_once(g, h, 0, n)
    edges = [0, n] if gain <= 0 else [0, at, n]
    if gain > 0:
        more = max((_cut_once(g, h, 0, at), _cut_once(g, h, at, n)))
        if more[0] > 0:
            edges = sorted({*edges, more[1]})
    out = np.zeros(n)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _depth_two(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree that cuts the rows of a grid once and each side's columns once, as a grid."""
    best, parts = -np.inf, []
    for r in range(1, g.shape[0]):
        gain, found = 0.0, []
        for lo, hi in ((0, r), (r, g.shape[0])):
            gs, hs = g[lo:hi].sum(0), h[lo:hi].sum(0)
            more, c = _cut_once(gs, hs, 0, len(gs))
            gain += more + _gain(gs.sum(), hs.sum())
            found += [(lo, hi, 0, c), (lo, hi, c, len(gs))]
        if gain > best:
            best, parts = gain, found
    out = np.zeros(g.shape)
    for lo, hi, a, b in parts:
        if b > a:
            out[lo:hi, a:b] = g[lo:hi, a:b].sum() / (h[lo:hi, a:b].sum() + RIDGE)
    return out


def boost(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the lookup tables on measures ``x`` and labels ``y``."""
    if len(y) == 0:
        return AdditiveModel()
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m = AdditiveModel(bias=float(np.log(p / (1 - p))))
    for q, to in ((BINS, m.cuts), (COARSE, m.coarse)):
        to += [np.unique(np.quantile(x[:, j], np.arange(1, q) / q)) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.cuts)]
    wide = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.coarse)]
    total = np.full(len(y), m.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _three_leaves(np.bincount(b, g, len(m.tables[j])), np.bincount(b, h, len(m.tables[j])))
            m.tables[j] += step
            total += step[b]
    g, h = slopes()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            wj = len(m.coarse[j]) + 1
            cell = wide[i] * wj + wide[j]
            size = (len(m.coarse[i]) + 1) * wj
            ranked.append((-float(_gain(np.bincount(cell, g, size), np.bincount(cell, h, size)).sum()), i, j))
    for _, i, j in sorted(ranked)[:PAIRS]:
        m.pairs.append((i, j))
        m.grids.append(np.zeros((len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)))
    for _ in range(PAIR_ROUNDS):
        for (i, j), grid in zip(m.pairs, m.grids, strict=True):
            if min(grid.shape) < 2:
                continue
            g, h = slopes()
            cell = wide[i] * grid.shape[1] + wide[j]
            step = RATE * _depth_two(np.bincount(cell, g, grid.size).reshape(grid.shape), np.bincount(cell, h, grid.size).reshape(grid.shape))
            grid += step
            total += step[wide[i], wide[j]]
    return m


def _each_slice(col: pa.Array) -> Iterator[np.ndarray]:
    for part in K.slices(pa.RecordBatch.from_arrays([col], names=["text"]), "text"):
        yield measures(*K.buffers(K.column(part, "text")))


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_train_docs: int = MAX_TRAIN_DOCS) -> AdditiveModel:
    """Learn ``label`` (0/1, by doc_id) on the documents whose label row satisfies ``usable``."""
    marked = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = F.broadcast(hash_sample(marked, "doc_id", max_train_docs))  # at most max_train_docs rows

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, len(FEATURES))), *_each_slice(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = project(docs, "doc_id", "text").join(sample, "doc_id").select("doc_id", "label", "text")
    got = rows.mapInArrow(measure, "doc_id long, label int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), float).reshape(-1, len(FEATURES))
    return boost(x, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (columns of these names are replaced); no shuffle."""

    @F.arrow_udf("double")
    @K.lean
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(x) for x in _each_slice(col))]))

    return docs.withColumn("score", scores(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
