"""Near-duplicate documents: ProbMinHash signatures, banding and exact verification.

Shingles are runs of ``SHINGLE`` words ``[^\\x20\\x09-\\x0D]+`` (all words of a
shorter text), each with weight 1 however often the text holds it, as the accepted
similarity is that of the sets. Each shingle starts a
Poisson process whose rate is its weight; every arrival falls into one of the
``BANDS * ROWS`` registers, drawn from the shingle's own hash sequence, and a
register keeps the shingle of its first arrival. A shingle stops as soon as its
next arrival is later than every register's time, so a document of n shingles
takes about n + k ln k arrivals. Two documents agree in a register with the
probability Jaccard similarity of their weighted shingles, with weights of 1 the
Jaccard similarity of the sets.

Copies (equal word sequences) are one class from the start and send one
representative into the search. Representatives that agree in all registers of a
band share a bucket. Buckets are worked off by hubs: the member that shares most
buckets is compared with all others, links join classes, and in a bucket that
still spans classes the most popular member outside the first hub's class is the
next hub. Of what still spans classes after ``HUB_ROUNDS`` rounds, all pairs that
can be similar are compared. A pair cannot if its sizes or maps rule it out: a map
has a bit for each shingle's hash, so a bit that only one side has is a shingle
that the other lacks, and counting those bounds the similarity from above. So every
pair of a bucket is compared, ruled out or in one class already, and a large group
of variants costs about a comparison a member. A comparison is the exact Jaccard similarity of the shingle
sets (32-bit hashes), at ``threshold`` = 4/5 or more.

Buckets, pairs and classes are DataFrames; the driver sees counts only. Shuffles
carry band keys and ids; shingle sets move only for documents that are compared.

The result names each document's class and no number of links: links are found until
a group is connected, so most pairs inside a group are never compared.

Edge cases: a null doc_id is left out; a text without words is alone in its
class; rows that repeat a doc_id are one document if any of their texts match; a
very long text is signed whole; ties in popularity go to the smaller doc_id; extra
columns are ignored, by ``keep_one`` kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import kernels as K
from strandloom.llm.common import project
from strandloom.operators.components import star_rounds
from strandloom.plans import scratch

SHINGLE, BANDS, ROWS = 5, 18, 5
#: Similarity as a ratio of integers.
THRESHOLD = (4, 5)
HUB_ROUNDS = 2
#: Ids of compared documents are sent to the executors up to this many bytes, else joined.
MAX_SENT_BYTES = 32 << 20
_SLICE = 1 << 20
_STEP = 0xA0761D6478BD642F
#: 64-bit words of the map of a document's shingles that bounds similarities from above.
MAP_WORDS = 16
_SIGNED = "doc_id long, copy_hi long, copy_lo long, n long, bands array<long>, map array<long>, shingles binary"


def shingle_sets(spans: K.Spans, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles, by row."""
    h, at = K.windows(spans, size)
    row = spans.row[at]
    per_row, first = spans.per_row(), spans.row_starts()
    short = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(short):  # all words of a short text are one shingle
        whole = np.array([K.mix64(np.array([np.sum(spans.hash[first[r] : first[r + 1]] * np.array(K._Q[: per_row[r]]))], np.uint64))[0] for r in short], np.uint64)
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Registers (n_rows x k) of the weighted sets; rows without elements stay 0."""
    time, reg = np.full(n_rows * k, np.inf), np.zeros(n_rows * k, np.uint64)
    some = np.zeros(n_rows, bool)
    some[row] = True
    t = np.zeros(len(h))
    active = np.arange(len(h))
    step = 0
    while len(active):
        x = K.mix64(h[active] + np.uint64(step))
        t[active] -= np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[active]
        slot = row[active] * k + (((K.mix64(x) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(time, slot, t[active])
        won = t[active] == time[slot]
        reg[slot[won]] = h[active[won]]
        last = time.reshape(n_rows, k).max(1)
        active = active[t[active] < last[row[active]]]
        step = (step + _STEP) % (1 << 64)
    return reg.reshape(n_rows, k)


def band_keys(reg: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    part = reg.reshape(len(reg), bands, rows)
    key = np.zeros((len(reg), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        key = K.mix64(key ^ part[:, :, j])
    return key


def signatures(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: copy fingerprint, number of distinct shingles, band keys and shingle set."""

    @K.lean
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", _SLICE):
                spans = K.words(*K.buffers(K.column(part, "text")))
                n, rows = spans.n_rows, spans.row_starts()
                seq = np.arange(len(spans.hash), dtype=np.uint64) - rows[spans.row].astype(np.uint64)
                prints = []
                for salt in (1, 2):  # fingerprints of the word sequence; without words, of the document
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, spans.row, K.mix64(spans.hash ^ K.mix64(seq * np.uint64(2) + np.uint64(salt << 60))))
                    empty = spans.per_row() == 0
                    doc = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                    total[empty] = K.mix64(doc[empty] + np.uint64(salt))
                    prints.append(pa.array(K.signed(total)))
                row, h, _ = shingle_sets(spans)
                keys = band_keys(prob_minhash(row, h, np.ones(len(h)), n, BANDS * ROWS))
                cut = np.searchsorted(row, np.arange(n + 1))
                sets = [np.unique((h[cut[i] : cut[i + 1]] >> np.uint64(32)).astype(np.uint32)) for i in range(n)]
                held = np.zeros((n, 64 * MAP_WORDS), bool)
                held[row, (h >> np.uint64(32)).astype(np.int64) % (64 * MAP_WORDS)] = True
                maps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * MAP_WORDS), pa.array(np.packbits(held, axis=1).view(np.int64).reshape(-1)))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(K.signed(keys.reshape(-1))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *prints, pa.array([len(s) for s in sets], pa.int64()), bands, maps, pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "copy_hi", "copy_lo", "n", "bands", "map", "shingles"],
                )

    return project(docs, "doc_id", "text").filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scan, _SIGNED)


def similar(a: bytes, b: bytes, threshold: tuple[int, int] = THRESHOLD) -> bool:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * threshold[1] >= threshold[0] * (len(both) - common) and common > 0


def verify(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar; ``sets``: doc_id, shingles."""
    spark = pairs.sparkSession
    pairs, path = scratch.write(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    n = ids.count()
    used = sets.join(F.broadcast(ids) if 8 * n <= MAX_SENT_BYTES else ids, "doc_id", "left_semi")

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similar(a, b, threshold) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    sides = [used.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab"]
    found, _ = scratch.write(pairs.join(sides[1], "b").join(sides[0], "a").filter(alike("sa", "sb")).select("a", "b"), "links")
    scratch.drop(spark, path)
    return found


def _possible(threshold: tuple[int, int]):
    """Sizes alone allow the similarity: the smaller over the larger set bounds it (of a doc_id with several texts: any of them)."""
    return F.least("n_most", "hub.n_most") * threshold[1] >= F.greatest("n", "hub.n") * threshold[0]


def _map_allows(threshold: tuple[int, int]):
    """The maps leave enough common shingles: at most those of one side without the bits that only it has."""
    alone = sum((F.bit_count(F.col(f"m{i}").bitwiseAND(F.bitwise_not(f"h{i}"))) for i in range(MAP_WORDS)), F.lit(0))
    return (F.col("n_most") - alone) * (threshold[0] + threshold[1]) >= (F.col("n") + F.col("hub.n")) * threshold[0]


def classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class): one row for each document."""
    signed = scratch.cut(signatures(docs), "signatures")
    copy = ["copy_hi", "copy_lo"]
    firsts = signed.groupBy(*copy).agg(F.min(F.struct("doc_id", "n")).alias("r")).select(*copy, F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"))
    firsts = scratch.cut(firsts, "copies")
    bands = signed.filter("n > 0").select("doc_id", "n", "bands").join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = scratch.cut(bands.select("doc_id", "n", F.explode("bands").alias("band")).groupBy("band", "doc_id").agg(F.min("n").alias("n"), F.max("n").alias("n_most")), "bands")
    sets = signed.filter("n > 0").select("doc_id", "shingles")
    shared = bands.join(bands.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "band")
    # the popular member of a bucket shares most buckets with others: the source of a group of variants
    popular = shared.groupBy("doc_id").agg((-F.sum("m")).alias("rank"))
    members = scratch.cut(shared.join(popular, "doc_id").select("band", "doc_id", "n", "n_most", "rank"), "members")
    stars = docs.sparkSession.createDataFrame([], "a long, b long")
    first_hub = None
    for turn in range(hub_rounds + 1):
        named = _with_class(members, stars)
        if first_hub is None:
            spans = named.groupBy("band").agg(F.min(F.struct("rank", "doc_id", "n", "n_most", "class")).alias("hub"))
            first_hub = spans.select("band", F.col("hub.doc_id").alias("h1"))
        else:
            old = _with_class(first_hub.withColumnRenamed("h1", "doc_id"), stars).select("band", F.col("class").alias("h1_class"))
            spans = named.join(old, "band").groupBy("band").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.min(F.struct(F.col("class") == F.col("h1_class"), "rank", "doc_id", "n", "n_most", "class")).alias("hub")).filter("c0 <> c1").select("band", "hub")
        # written, so that both sides of the join are plain and Spark can split a large bucket
        spans = scratch.cut(spans, "spans")
        left = scratch.cut(named.join(spans, "band"), "members")
        if left.isEmpty():
            break
        if turn == 0:
            first_hub = scratch.cut(first_hub, "hubs")
        if turn < hub_rounds:
            met = left.filter("doc_id <> hub.doc_id")
            members = met.select("band", "doc_id", "n", "n_most", "rank")
        else:  # the rest: all pairs of a bucket that are in different classes and may be similar
            # bits of all texts of a doc_id: those that each holds bound from below what it has, those that any holds from above
            maps = signed.groupBy("doc_id").agg(*[f(F.col("map")[i]).alias(f"{k}{i}") for i in range(MAP_WORDS) for f, k in ((F.bit_and, "m"), (F.bit_or, "h"))])
            mapped = left.drop("hub").join(maps, "doc_id")
            other = mapped.select("band", F.struct("doc_id", "n", "n_most", "class").alias("hub"), *[f"h{i}" for i in range(MAP_WORDS)])
            mapped = mapped.drop(*[f"h{i}" for i in range(MAP_WORDS)])
            met = mapped.join(other, "band").filter((F.col("hub.class") != F.col("class")) & (F.col("hub.doc_id") < F.col("doc_id")) & _possible(threshold) & _map_allows(threshold))
        pairs = met.filter((F.col("hub.class") != F.col("class")) & _possible(threshold)).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        found = verify(pairs, sets, threshold)
        if not found.isEmpty():
            stars = star_rounds(stars.unionByName(found))
    out = signed.select("doc_id", *copy).join(firsts.select(*copy, "rep"), copy).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("__other"))
    # a doc_id whose rows have several texts ties their classes together
    ties = out.filter("rep <> __other").select(F.col("__other").alias("a"), F.col("rep").alias("b"))
    if not ties.isEmpty():
        ties = signed.select("doc_id", *copy).join(firsts.select(*copy, "rep"), copy).join(out.select("doc_id", F.col("rep").alias("b")), "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
        stars = star_rounds(stars.unionByName(ties))
    named = out.select("doc_id", "rep").join(stars.select(F.col("a").alias("rep"), F.col("b").alias("class")), "rep", "left")
    return named.select("doc_id", F.coalesce("class", "rep").alias("class_id"))


def _with_class(rows: DataFrame, stars: DataFrame) -> DataFrame:
    return rows.join(stars.select(F.col("a").alias("doc_id"), F.col("b").alias("class")), "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))


def keep_one(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with only the smallest doc_id of each class, all columns; rows without doc_id stay."""
    gone = classes(docs, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
