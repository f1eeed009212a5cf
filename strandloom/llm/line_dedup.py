"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends
and with A-Z in lower case. ``LineIndex`` holds the exact references (key,
document): inserting documents appends references, deleting documents removes
theirs, so the counts and every decision that follows from them are what they
would be if the deleted documents had never been there. From the references
come

* the exact table: keys held by at least ``min_docs`` documents, with their
  count and the largest ``doc_id`` that holds them;
* one cuckoo filter for each shard of those keys, two bytes a key. Lines are
  probed against the filters where the text is read; only lines that may be
  frequent travel to the exact table, which decides.

While the filters are below ``max_filter_bytes`` (known from the key count) they
are sent to the executors and lines are probed where the text is read. Beyond it the
lines' references travel to their shard and are probed there, a shard's lines dealt
to as many tasks as their number asks for. An index keeps its filters: inserting
documents adds the keys that became frequent, deleting takes out those that no longer
are, and only shards that overflow are built anew. Keys are 128-bit digests.

Only documents that lose a line are joined with their lost keys; the others pass by
as they are, while the touched ones' ids may be sent.

Edge cases: a null or empty text is one empty line; lines shorter than
``min_chars`` code points always stay; a null ``doc_id`` is kept as a document
whose lines are never dropped and never counted; rows with the same ``doc_id``
count as one document and are cleaned alike. A document that holds a key several
times keeps or loses all those lines together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm.common import project
from strandloom.plans import scratch

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard at most, on average; a shard's filter then has about 2.2 MB.
SHARD_KEYS = 1 << 20
MAX_FILTER_BYTES = 32 << 20
#: Ids of the documents that lose a line are sent to the executors up to this many bytes.
MAX_SENT_BYTES = 32 << 20
#: References that one task probes against a shard, on average.
GROUP_ROWS = 1 << 18
_SLOTS, _LOAD, _KICKS = 4, 0.9, 500
_REFS = "hi long, lo long, doc_id long"
_FILTERS = "shard int, filter binary"
_SETTINGS = "min_chars int, min_docs int, shards int"
_CLEANED = "struct<text:string,n_lines:long,n_dropped:long>"


# --- cuckoo filter -------------------------------------------------------------------------------


class CuckooFilter:
    """Cuckoo filter with four 16-bit fingerprints a bucket; insert, delete and vectorised probe.

    Buckets are a power of two, the partner bucket is the bucket xor a hash of
    the fingerprint. An insertion that finds no place after ``_KICKS`` moves
    doubles the filter, which needs the keys again, so builders pass all keys.
    """

    def __init__(self, n_keys: int) -> None:
        need = max(1, int(np.ceil(n_keys / (_SLOTS * _LOAD))))
        self.table = np.zeros((1 << (need - 1).bit_length(), _SLOTS), np.uint16)

    @staticmethod
    def size_bytes(n_keys: int) -> int:
        need = max(1, int(np.ceil(n_keys / (_SLOTS * _LOAD))))
        return (1 << (need - 1).bit_length()) * _SLOTS * 2

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        n = len(keys)
        while True:
            made = cls(n)
            if made._insert_all(keys):
                return made
            n = max(2 * n, 8)

    @classmethod
    def load(cls, raw: bytes, writable: bool = False) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(bytearray(raw) if writable else raw, np.uint16).reshape(-1, _SLOTS)
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = ((keys >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        first = (keys & np.uint64(len(self.table) - 1)).astype(np.int64)
        return fp, first, first ^ self._hop(fp)

    def _hop(self, fp: np.ndarray) -> np.ndarray:
        return (K.mix64(fp.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _insert_all(self, keys: np.ndarray) -> bool:
        fp, first, second = self._place(keys)
        left = np.arange(len(keys))
        for bucket in (first, second):  # whole rounds: one key for each free slot
            for slot in range(_SLOTS):
                free = left[self.table[bucket[left], slot] == 0]
                _, one = np.unique(bucket[free], return_index=True)
                took = free[one]
                self.table[bucket[took], slot] = fp[took]
                left = np.setdiff1d(left, took, assume_unique=True)
        return all(self._kick(int(fp[i]), int(first[i])) for i in left)

    def _kick(self, fp: int, bucket: int) -> bool:
        for step in range(_KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fp
                return True
            slot = step % _SLOTS
            fp, row[slot] = int(row[slot]), fp
            bucket ^= int(self._hop(np.array([fp], np.uint16))[0])
        return False

    def insert(self, key: int) -> bool:
        fp, first, second = self._place(np.array([key], np.uint64))
        for bucket in (int(first[0]), int(second[0])):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fp[0]
                return True
        return self._kick(int(fp[0]), int(first[0]))

    def delete(self, key: int) -> bool:
        fp, first, second = self._place(np.array([key], np.uint64))
        for bucket in (int(first[0]), int(second[0])):
            held = np.flatnonzero(self.table[bucket] == fp[0])
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def probe(self, keys: np.ndarray) -> np.ndarray:
        fp, first, second = self._place(keys)
        fp = fp[:, None]
        return (self.table[first] == fp).any(1) | (self.table[second] == fp).any(1)


# --- line keys -----------------------------------------------------------------------------------


def line_keys(data: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """All lines of a slice: start, end, row, two key hashes, and whether the key is long enough."""
    start, end, row = K.lines(data, off)
    low = K.ASCII_LOWER[data]
    s, e = K.strip(low, start, end)
    hi, lo = K.span_hash(low, s, e, 0, 1)
    return start, end, row, hi, lo, K.code_points(low, s, e) >= min_chars


def _unique_refs(doc: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((lo, hi, doc))
    doc, hi, lo = doc[order], hi[order], lo[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return pa.RecordBatch.from_arrays([pa.array(K.signed(hi[new])), pa.array(K.signed(lo[new])), pa.array(doc[new])], names=["hi", "lo", "doc_id"])


def references(docs: DataFrame, min_chars: int = MIN_CHARS, filters=None) -> DataFrame:
    """Distinct (hi, lo, doc_id) of all long lines, or of those that the filters let through."""

    @K.lean
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = filters.value if filters else None
        for batch in batches:
            for part in K.slices(batch, "text"):
                data, off = K.buffers(K.column(part, "text"))
                _, _, row, hi, lo, long = line_keys(data, off, min_chars)
                if probes is not None:
                    long = np.flatnonzero(long)
                    shard = (hi[long] >> np.uint64(20)) % np.uint64(len(probes))
                    hit = np.zeros(len(long), bool)
                    for k, raw in enumerate(probes):
                        at = np.flatnonzero(shard == k)
                        if raw and len(at):
                            hit[at] = CuckooFilter.load(raw).probe(lo[long[at]])
                    long = long[hit]
                doc = part.column(0).to_numpy(zero_copy_only=False)[row[long]]
                yield _unique_refs(doc, hi[long], lo[long])

    known = project(docs, "doc_id", "text").filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    return known.mapInArrow(scan, _REFS)


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("hi", 20), F.lit(shards).cast("long")).cast("int")


@dataclass
class LineIndex:
    """Exact references of a collection's long lines, and the filters of its frequent keys; immutable, each change gives a new index.

    ``filters``: (shard, filter), or None until ``with_filters``.
    """

    refs: DataFrame
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    filters: DataFrame | None = None
    shards: int = 0

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        return cls(references(docs, min_chars), min_chars, min_docs)

    def with_filters(self, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """With a filter for each shard of the keys that are frequent now."""
        frequent = scratch.cut(self.frequent(), "line-keys")
        shards = max(1, -(-frequent.count() // shard_keys))
        return replace(self, filters=scratch.cut(build_filters(frequent, shards), "filters"), shards=shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents' references too; documents already in the index change nothing."""
        new = scratch.cut(references(docs, self.min_chars), "line-refs")
        return self._changed(self.refs.unionByName(new), new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the references of the documents in column ``doc_id``."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        lost = scratch.cut(self.refs.join(gone, "doc_id", "left_semi").select("hi", "lo", "doc_id"), "line-refs")
        return self._changed(self.refs.join(gone, "doc_id", "left_anti").select("hi", "lo", "doc_id"), lost)

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The index on other references; only keys of ``touched`` can have become frequent or rare."""
        after = replace(self, refs=refs)
        if self.filters is None:
            return after
        keys = touched.select("hi", "lo").distinct()
        was, now = (replace(x, refs=x.refs.join(keys, ["hi", "lo"], "left_semi")).frequent().select("hi", "lo") for x in (self, after))
        both = was.withColumn("old", F.lit(1)).join(now.withColumn("new", F.lit(1)), ["hi", "lo"], "full")
        change = both.filter("old IS NULL OR new IS NULL").select(_shard(self.shards).alias("shard"), "lo", F.col("new").isNotNull().alias("add"))

        def turn(held: pa.Table, change: pa.Table) -> pa.Table:
            raw = held.column("filter")[0].as_py() if held.num_rows else None
            shard = (held if held.num_rows else change).column("shard")[0].as_py()
            made = CuckooFilter.load(raw, writable=True) if raw is not None else CuckooFilter(change.num_rows)
            keys, add = change.column("lo").to_numpy().view(np.uint64), change.column("add").to_numpy()
            whole = all([made.delete(int(k)) for k in keys[~add]]) and all(made.insert(int(k)) for k in keys[add])
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.dump() if whole else None], pa.binary())})

        turned = scratch.cut(self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(turn, _FILTERS), "filters")
        full = turned.filter("filter IS NULL").select("shard")
        if not full.isEmpty():  # too small now: built anew from the exact table
            again = build_filters(after.frequent().withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi").drop("shard"), self.shards)
            turned = scratch.cut(turned.filter("filter IS NOT NULL").unionByName(again), "filters")
        return replace(after, filters=turned)

    def save(self, path: str) -> None:
        """References, filters and settings as tables below ``path``."""
        spark = self.refs.sparkSession
        self.refs.write.parquet(f"{path}/refs")
        (self.filters if self.filters is not None else spark.createDataFrame([], _FILTERS)).write.parquet(f"{path}/filters")
        spark.createDataFrame([(self.min_chars, self.min_docs, self.shards)], _SETTINGS).write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        """What ``save`` wrote."""
        chars, docs, shards = spark.read.schema(_SETTINGS).parquet(f"{path}/settings").first()
        filters = spark.read.schema(_FILTERS).parquet(f"{path}/filters") if shards else None
        return cls(spark.read.schema(_REFS).parquet(f"{path}/refs"), chars, docs, filters, shards)

    def frequent(self, distinct: bool = True) -> DataFrame:
        """Keys held by ``min_docs`` documents or more: hi, lo, n_docs, last_doc.

        ``distinct``: references may repeat (documents inserted twice, or rows with
        one ``doc_id``), so they are made distinct first. The second aggregation
        reuses the distribution by key, and partial sums keep hot keys small.
        """
        n = F.countDistinct("doc_id") if distinct else F.count("*")
        return self.refs.groupBy("hi", "lo").agg(n.alias("n_docs"), F.max("doc_id").alias("last_doc")).filter(F.col("n_docs") >= self.min_docs)


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): one cuckoo filter for each shard of the keys, built on the executors."""

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("lo").to_numpy().view(np.uint64)
        return pa.table({"shard": table.column("shard").slice(0, 1), "filter": pa.array([CuckooFilter.build(keys).dump()], pa.binary())})

    return frequent.select(_shard(shards).alias("shard"), "lo").groupBy("shard").applyInArrow(build, _FILTERS)


def probe_by_shard(refs: DataFrame, filters: DataFrame, shards: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The references (hi, lo, doc_id) that their shard's filter lets through; a shard with many is probed in several tasks."""
    refs = scratch.cut(refs.withColumn("shard", _shard(shards)), "line-refs")
    parts = refs.groupBy("shard").agg(F.ceil(F.count("*") / group_rows).alias("parts"))
    dealt = refs.join(F.broadcast(parts), "shard").select("shard", F.pmod(F.xxhash64("doc_id", "lo"), F.col("parts")).alias("part"), "hi", "lo", "doc_id")  # a row a shard
    copies = filters.join(F.broadcast(parts), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "filter")

    def probe(rows: pa.Table, held: pa.Table) -> pa.Table:
        keys = rows.column("lo").to_numpy().view(np.uint64)
        hit = CuckooFilter.load(held.column("filter")[0].as_py()).probe(keys) if held.num_rows else np.zeros(len(keys), bool)
        return rows.select(["hi", "lo", "doc_id"]).filter(pa.array(hit))

    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(probe, _REFS)


def _clean(text: str | None, lost: list[dict], min_chars: int) -> dict:
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    start, end, _, hi, lo, long = line_keys(data, np.array([0, len(raw)]), min_chars)
    drop = {(k["hi"], k["lo"]) for k in lost}
    gone = np.fromiter(((h, v) in drop for h, v in zip(K.signed(hi).tolist(), K.signed(lo).tolist(), strict=True)), bool, len(hi)) & long
    kept = b"\n".join(raw[s:e] for s, e in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True))
    return {"text": kept.decode(), "n_lines": len(start), "n_dropped": int(gone.sum())}


def apply_index(docs: DataFrame, index: LineIndex, max_filter_bytes: int = MAX_FILTER_BYTES, same_docs: bool = False, max_sent_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """``docs`` without the frequent lines that another, larger document keeps.

    All columns stay; ``text`` is the cleaned text and n_lines, n_dropped are
    added (columns of these names are replaced). ``same_docs``: the documents are
    those of the index; their references are then read from it and not scanned
    again where the filters are too large to send.
    """
    spark = docs.sparkSession
    frequent, _ = scratch.write(index.frequent(), "line-keys")
    n_keys = frequent.count()
    if not n_keys:
        return docs.withColumns(_as_is())
    shards = index.shards or max(1, -(-n_keys // SHARD_KEYS))
    filters = index.filters if index.filters is not None else build_filters(frequent, shards)
    if shards * CuckooFilter.size_bytes(-(-n_keys // shards)) <= max_filter_bytes:
        made: list[bytes] = [b""] * shards
        for r in filters.collect():
            made[r["shard"]] = bytes(r["filter"])
        refs = references(docs, index.min_chars, spark.sparkContext.broadcast(made))
    else:
        refs = probe_by_shard(index.refs if same_docs else references(docs, index.min_chars), filters, shards)
    lost = (
        refs.join(frequent, ["hi", "lo"])
        .filter("doc_id < last_doc")
        .groupBy(F.col("doc_id").alias("__doc"))
        .agg(F.collect_set(F.struct("hi", "lo")).alias("__lost"))
    )
    lost = scratch.cut(lost, "lost-lines")
    on = docs["doc_id"].cast("long") == F.col("__doc")
    ids = lost.select("__doc")
    if 8 * ids.count() <= max_sent_bytes:  # only touched texts are shuffled
        ids = F.broadcast(ids)
        return _without(docs.join(ids, on, "left_semi").join(lost.hint("merge"), on), index.min_chars).unionByName(docs.join(ids, on, "left_anti").withColumns(_as_is()))
    return _without(docs.join(lost, on, "left"), index.min_chars)


def _without(both: DataFrame, min_chars: int) -> DataFrame:
    """Rows with the keys they lose (``__lost``, or null) as rows without those lines."""

    @F.arrow_udf(_CLEANED)
    def cleaned(texts: pa.Array, keys: pa.Array) -> pa.Array:
        out = [_clean(t, k or [], min_chars) for t, k in zip(texts.to_pylist(), keys.to_pylist(), strict=True)]
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))

    touched = F.col("__lost").isNotNull()  # other rows send no text to Python
    done = both.withColumn("__cleaned", cleaned(F.when(touched, F.col("text")), F.col("__lost")))
    return done.withColumns({k: F.when(touched, F.col(f"__cleaned.{k}")).otherwise(v) for k, v in _as_is().items()}).drop("__doc", "__lost", "__cleaned")


def _as_is() -> dict:
    text = F.coalesce(F.col("text"), F.lit(""))
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return {"n_lines": (feeds + 1).cast("long"), "n_dropped": F.lit(0).cast("long"), "text": text}


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Build the index of ``docs`` and apply it to them: see the module's text."""
    return apply_index(docs, LineIndex.of(docs, min_chars, min_docs), max_filter_bytes, same_docs=True)

