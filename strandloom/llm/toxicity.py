"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed unigrams, bigrams and skip-grams (one word
between) of its lower-cased letter runs, present or absent. Unigrams are taken of
the word and of its stems, the first four to eight bytes, because languages
that compound and inflect seldom repeat a whole word. The learner keeps a
rate for each coordinate and an L1 penalty, so nearly all weights are exactly
zero and the model is a short list of (index, weight): it is sent to the
executors, and its size is bounded by ``1 << BITS`` whatever the corpus.

Fitting reads at most ``max_train_docs`` labelled documents (a hash sample beyond
that) with their whole texts; the features are made in parallel and written, and one
task runs the sequential learner over them, in the order of a hash of ``doc_id``. It
gets at most about ``max_train_bytes`` of features: with more, a hash sample again.
Scoring reads every whole text once, without a shuffle.

Edge cases: a null or empty text has no features and gets the bias' score; with
no labelled rows nothing is rejected (all scores are close to 0); labels that are null are ignored; a doc_id
that occurs in several rows is scored row by row and, when labelled, trains once
for each row; extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm.common import hash_sample, project
from strandloom.plans import scratch

BITS = 20
#: Labelled documents read for the fit at most.
MAX_TRAIN_DOCS = 12_000
#: Bytes of their features (four each) that the learning task gets at most, about.
MAX_TRAIN_BYTES = 160 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 10.0, 1.0, 4

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False
#: Bytes of the stems.
STEMS = (4, 5, 6, 7, 8)
_KIND = K.mix64(np.arange(16, dtype=np.uint64))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all n-grams of a slice of lower-cased texts, with repeats."""
    spans = K.words(data, off, _NO_LETTER)
    rows, keys = [spans.row], [spans.hash ^ _KIND[0]]
    for kind, gap in ((1, 1), (2, 2)):
        if len(spans.hash) > gap:
            same = np.flatnonzero(spans.row[:-gap] == spans.row[gap:])
            rows.append(spans.row[same])
            keys.append(spans.hash[same] * np.uint64(3) + K.mix64(spans.hash[same + gap]) ^ _KIND[kind])
    for kind, size in enumerate(STEMS, 3):
        long = np.flatnonzero(spans.end - spans.start > size)
        rows.append(spans.row[long])
        keys.append(K.span_hash(data, spans.start[long], spans.start[long] + size) ^ _KIND[kind])
    return np.concatenate(rows), (K.mix64(np.concatenate(keys)) >> np.uint64(64 - BITS)).astype(np.int64)


def _lower(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return K.buffers(pc.utf8_lower(K.column(part, "text")))


@dataclass
class ToxicityModel:
    """Non-zero weights by feature index, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float64)
        w[self.index] = self.weight
        return w


def ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> ToxicityModel:
    """Follow the regularised leader over the documents' feature sets (each with the bias' index at the end), in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    if rows:  # the bias starts at the log odds
        p = min(max(sum(labels) / len(labels), 1e-3), 1 - 1e-3)
        prior = float(np.log(p / (1 - p)))
    else:
        prior = -20.0

    def weights(at: np.ndarray) -> np.ndarray:
        sign = np.sign(z[at])
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - sign * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + prior, -35, 35))) - y
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    index = np.flatnonzero(w[:-1])
    return ToxicityModel(index, w[index], prior + float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES) -> ToxicityModel:
    """Learn ``label`` (0/1, by doc_id) on the documents whose label row satisfies ``usable``."""
    marked = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = F.broadcast(hash_sample(marked, "doc_id", max_train_docs))  # at most max_train_docs rows

    @K.lean
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                row, at = features(*_lower(part))
                pair = np.unique(row << BITS | at)
                cut = np.searchsorted(pair, np.arange(part.num_rows + 1) << BITS)
                at = (pair & ((1 << BITS) - 1)).astype(np.int32)
                bias = np.array([1 << BITS], np.int32).tobytes()
                sets = [at[cut[i] : cut[i + 1]].tobytes() + bias for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["doc_id", "label", "features"])

    @K.lean
    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ys = [], []
        for batch in batches:
            sets += [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            ys += batch.column(1).to_pylist()
        m = ftrl(sets, ys)
        yield pa.RecordBatch.from_arrays([pa.array([m.index.astype(np.int64).tobytes()]), pa.array([m.weight.tobytes()]), pa.array([m.bias])], names=["at", "w", "bias"])

    rows = project(docs, "doc_id", "text").join(sample, "doc_id").select("doc_id", "label", "text")
    encoded, path = scratch.write(rows.mapInArrow(encode, "doc_id long, label int, features binary"), "toxic-train")
    total = encoded.agg(F.sum(F.length("features"))).first()[0] or 0
    if total > max_train_bytes:  # fewer documents, by another hash than the order of learning
        encoded = encoded.filter(F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(1 << 30)) < int(0.9 * max_train_bytes / total * (1 << 30)))
    found = encoded.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "features").mapInArrow(learn, "at binary, w binary, bias double").collect()
    scratch.drop(docs.sparkSession, path)
    if not found:  # no labelled document, no task
        return ftrl([], [])
    r = found[0]
    return ToxicityModel(np.frombuffer(bytes(r["at"]), np.int64), np.frombuffer(bytes(r["w"]), np.float64), r["bias"])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score and predicted (columns of these names are replaced); no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))  # below 1 << BITS pairs

    @F.arrow_udf("double")
    @K.lean
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, weight, bias = sent.value
        w = ToxicityModel(index, weight, bias).dense()
        for col in batches:
            batch = pa.RecordBatch.from_arrays([col], names=["text"])
            out = [np.zeros(0)]
            for part in K.slices(batch, "text"):
                row, at = features(*_lower(part))
                hit = np.flatnonzero(w[at])
                pair = np.unique(row[hit] << BITS | at[hit])
                total = np.bincount(pair >> BITS, w[pair & ((1 << BITS) - 1)], part.num_rows) + bias
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.array(np.concatenate(out))

    return docs.withColumn("score", scores(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
