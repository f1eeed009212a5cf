"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams are runs of one to three code points of the lower-cased text in which
everything but letters is one separator; they are hashed into ``1 << BITS``
buckets. Fitting counts buckets by language over at most ``max_train_docs``
labelled documents (a hash sample beyond that, whole texts), summed by task and
then by language. The log-probability matrix (languages x buckets, float64) is
sent to the executors; scoring gathers the matrix rows of a slice's n-grams and
adds them up by document in NumPy, one pass, no shuffle.

The score is the posterior of the predicted language. Edge cases: a text that is
null or has no letter is ``und`` with score 0, as is every text when nothing was
learned; ties go to the first language by name; a null lang never trains; a very long
text counts whole; rows that repeat a doc_id are learned and judged row by row; extra
columns are kept, and lang_pred and score replaced.
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

BITS, ORDER, SMOOTHING = 15, 3, 0.5
#: Labelled documents read for the fit at most.
MAX_TRAIN_DOCS = 12_000
#: Each task's counts of a language travel in so many parts, so one language is summed in several tasks of a few MB.
PARTS = 32
UNKNOWN = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _points(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the letters and separators of all texts, their row, and whether a row has a letter.

    A letter is what Unicode calls one; runs of other characters become one 0.
    """
    low = pc.utf8_lower(col)
    text = pc.replace_substring_regex(low, r"[^\p{L}]+", " ")
    data = "".join(f" {t} " for t in text.to_pylist())
    cp = np.frombuffer(data.encode("utf-32-le"), np.uint32)
    length = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    row = np.repeat(np.arange(len(col)), length)
    has = np.zeros(len(col), bool)
    has[row[cp != 32]] = True
    return cp, row, has


def ngrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams with a letter, and whether a row has a letter."""
    cp, row, has = _points(col)
    h = np.zeros(len(cp), np.uint32)
    rows, buckets = [], []
    for n in range(ORDER):
        m = len(cp) - n
        if m <= 0:
            break
        h = (h[:m] + cp[n:] * _MIX[n]) * np.uint32(0x27D4EB2F) ^ np.uint32(n)
        use = row[:m] == row[n:]
        if n < 2:  # a lone separator, or two of them, say nothing
            use &= (cp[:m] != 32) | (cp[n:] != 32)
        use = np.flatnonzero(use)
        rows.append(row[use])
        x = h[use]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        buckets.append((x >> np.uint32(32 - BITS)).astype(np.int32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), has
    return np.concatenate(rows), np.concatenate(buckets), has


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # languages x buckets
    prior: np.ndarray


def fit(docs: DataFrame, usable: Column, max_train_docs: int = MAX_TRAIN_DOCS) -> LanguageModel:
    """Learn ``lang`` from the texts of the rows that satisfy ``usable``."""
    marked = project(docs, "doc_id", "text", "lang").filter(usable & F.col("lang").isNotNull())
    keys = F.broadcast(hash_sample(marked.select("doc_id").distinct(), "doc_id", max_train_docs))  # at most max_train_docs rows

    @K.lean
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for part in K.slices(batch, "text"):
                langs = part.column(0).to_pylist()
                row, bucket, _ = ngrams(K.column(part, "text"))
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs])
                for k, name in enumerate(names):
                    got = np.bincount(bucket[code[row] == k], minlength=1 << BITS)
                    total[name] = total.get(name, 0) + got
                    seen[name] = seen.get(name, 0) + int((code == k).sum())
        for name in sorted(total):
            parts = total[name].astype(np.int64).reshape(PARTS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * PARTS), pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([seen[name]] + [0] * (PARTS - 1), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())],
                names=["lang", "part", "docs", "counts"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << BITS) // PARTS, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"lang": table.column("lang").slice(0, 1), "part": table.column("part").slice(0, 1), "docs": pa.array([pc.sum(table.column("docs")).as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, part int, docs long, counts binary"
    found = marked.join(keys, "doc_id", "left_semi").select("lang", "text").mapInArrow(count, schema).groupBy("lang", "part").applyInArrow(add, schema).collect()  # languages x 256 KB
    langs = sorted({r["lang"] for r in found})
    counts, docs_seen = np.zeros((len(langs), PARTS, (1 << BITS) // PARTS)), np.zeros(len(langs))
    for r in found:
        counts[langs.index(r["lang"]), r["part"]] = np.frombuffer(bytes(r["counts"]), np.int64)
        docs_seen[langs.index(r["lang"])] += r["docs"]
    counts = counts.reshape(len(langs), 1 << BITS) + SMOOTHING
    return LanguageModel(langs, np.log(counts / counts.sum(1, keepdims=True)), np.log(docs_seen / max(docs_seen.sum(), 1)))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced); no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.prior))  # languages x 1 << BITS

    @F.arrow_udf("struct<lang:string,score:double>")
    @K.lean
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, logp, prior = sent.value
        for col in batches:
            batch = pa.RecordBatch.from_arrays([col], names=["text"])
            out = []
            for part in K.slices(batch, "text"):
                row, bucket, has = ngrams(K.column(part, "text"))
                total = np.array([np.bincount(row, p[bucket], part.num_rows) for p in logp]).reshape(len(langs), part.num_rows) + prior[:, None]
                if not langs:
                    out += [{"lang": UNKNOWN, "score": 0.0}] * part.num_rows
                    continue
                k = total.argmax(0)
                posterior = 1 / np.exp(np.maximum(total - total.max(0), -700)).sum(0)
                out += [{"lang": langs[i], "score": float(s)} if h else {"lang": UNKNOWN, "score": 0.0} for i, s, h in zip(k, posterior, has, strict=True)]
            yield pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return docs.withColumn("__best", best(F.col("text"))).withColumns({"lang_pred": F.col("__best.lang"), "score": F.col("__best.score")}).drop("__best")
