"""Unitigs of short k-mers without a row for each k-mer.

Two bits a k-mer, of those without exactly one letter before and after, tell whether two
neighbours in a read are linked: the first has one way out, the second one way in, and they
are not each other's reverse complement. So a task cuts its reads into runs of linked k-mers.
A run is a whole unitig unless a read begins or ends inside one. The k-mers at which that may
be, two for each read at most, are cuts: a run of its own, so that whatever lies between
cuts and ends of unitigs is spanned by each read that has any of it. Runs that are linked
to a cut are few; they are put together by doubled pointers. All others travel as packed keys.

``n`` is the number of letters' places that runs take up, so it needs no k-mer's count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import codes as C
from strandloom.functions import seq as S
from strandloom.operators import graph, packed
from strandloom.operators.packed import MAX_K, RANGE, Part, Texts
from strandloom.plans import scratch

#: Keys that a task sorts at a time, as a power of two, beside the table that it holds; letters of a slice, so that its arrays stay in a core's cache.
FLUSH, SLICE = 21, 1 << 16
_OPEN = "kmer long, other long, next long, back long, body string, kmers long, n long"


class Table:
    """Two bits for each place, sent deflated by ranges and held whole where they are read."""

    def __init__(self, parts: list[tuple[int, bytes]], size: int):
        self.parts, self.size, self._held = parts, size, None

    def __reduce__(self):
        return Table, (self.parts, self.size)

    def at(self, place: np.ndarray) -> np.ndarray:
        if self._held is None:  # in a worker, so what was sent can go
            self._held = np.zeros(self.size // 4, np.uint8)
            for b, bits in self.parts:
                self._held[b << (RANGE - 2) : (b + 1) << (RANGE - 2)] = np.frombuffer(zlib.decompress(bits), np.uint8)
            self.parts = []
        shift = place.astype(np.uint8) & 3
        return self._held[place >> 2] >> (shift << 1) & 3


class Cuts:
    """Some places: in order, or all places as bits."""

    def __init__(self, places: np.ndarray, span: int):
        self.dense = len(places) > span // 64
        if self.dense:
            self.places = np.zeros(span // 8, np.uint8)
            np.bitwise_or.at(self.places, places >> 3, (1 << (places & 7)).astype(np.uint8))
        else:
            self.places = places.astype(np.int32)
        self._some: np.ndarray | None = None

    def at(self, place: np.ndarray) -> np.ndarray:
        """Which of the places are among them."""
        if self.dense:
            return np.flatnonzero(self.places[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        if not len(self.places):
            return np.zeros(0, np.int64)
        if self._some is None:  # by their last bits, so that few are looked up in order
            self._some = np.zeros(1 << min(len(self.places).bit_length() + 7, 24), bool)
            self._some[self.places & (len(self._some) - 1)] = True
        x = np.flatnonzero(self._some[place & (len(self._some) - 1)])
        y = place[x].astype(np.int32)
        return x[self.places[np.minimum(np.searchsorted(self.places, y), len(self.places) - 1)] == y]


@dataclass
class Ways:
    """Of the reads' k-mers: which have not one way in (bit 0 of the strand with A or C in the middle) or out (bit 1), and the cuts."""

    k: int
    ends: Broadcast
    cuts: Broadcast


def ways(reads: DataFrame | Texts, k: int) -> Ways:
    if k % 2 == 0 or not 1 <= k <= MAX_K:
        raise ValueError(f"packed unitigs need an odd k up to {MAX_K}, not {k}")

    def windows(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray]]:
        for w in C.windows(data, off, k):
            own, place = packed._strand(w.code, w.rc, k)
            here, there = C.masks(w.prev, w.next)
            x = place << 10 | np.where(own, here, there)
            for at, begins in ((np.flatnonzero(w.prev == 4), own), (np.flatnonzero(w.next == 4), ~own)):
                x[at] |= np.where(begins[at], 1 << 8, 1 << 9)
            yield (x,)

    def whole(bucket: int, parts: Iterator[Part]) -> Iterator[pa.RecordBatch]:
        size, known, parts = packed._space(parts)
        mask, seen = np.zeros(size, np.uint16), np.zeros(size, bool)
        for p in parts:
            mask[p.keys] |= p.value.astype(np.uint16)
            seen[p.keys] = True
        no_in, no_out = (seen & (packed._ONES[mask >> s & 15] != 1) for s in (0, 4))
        cut = (mask >> 8 & 1 > 0) & ~no_in | (mask >> 9 & 1 > 0) & ~no_out
        at = np.arange(size) if known is None else known
        bits = np.zeros((1 << RANGE, 2), bool)
        bits[at, 0], bits[at, 1] = no_in, no_out
        row = [bucket], [zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], [zlib.compress(at[cut].astype("<u4").tobytes(), 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "bits", "cuts"])

    spark = _spark(reads)
    found = packed._collected(spark, lambda: packed._by_range(packed._scan(reads, windows, packed._pack_masks(2 * k - 1, 10), flush=FLUSH, limit=SLICE), whole, "bucket int, bits binary, cuts binary")).sort_by("bucket")
    buckets, span = found["bucket"].to_pylist(), max(1 << (2 * k - 1), 8)
    parts = list(zip(buckets, found["bits"].to_pylist(), strict=True))
    cuts = [(b << RANGE) + np.frombuffer(zlib.decompress(x.as_py()), "<u4").astype(np.int64) for b, x in zip(buckets, found["cuts"], strict=True)]
    send = spark.sparkContext.broadcast
    return Ways(k, send(Table(parts, max(span, 1 << RANGE))), send(Cuts(np.concatenate([np.zeros(0, np.int64), *cuts]), span)))


def _spark(reads: DataFrame | Texts) -> SparkSession:
    return (reads.frame if isinstance(reads, Texts) else reads).sparkSession


@dataclass
class Runs:
    """Runs of linked k-mers: places of the first and last k-mer, code of the first and of the last one's reverse complement, whether they are cuts,
    and the code of the linked k-mer after and the reverse complement of the one before, if one of both is a cut (else -1)."""

    a: np.ndarray
    b: np.ndarray
    first: np.ndarray
    last: np.ndarray
    cut: np.ndarray
    after: np.ndarray
    before: np.ndarray

    def open(self) -> np.ndarray:
        return self.cut | (self.after >= 0) | (self.before >= 0)


def _runs(data: np.ndarray, off: np.ndarray, known: Ways) -> Iterator[Runs]:
    """The runs of all sequences; at most one more than the windows of a step are held."""
    k, table, cuts = known.k, known.ends.value, known.cuts.value
    kept: list[np.ndarray] = []  # of the last k-mer: row, place, codes, whether it has not one way in or out, or is a cut
    head: list[np.ndarray] = []  # of the run that is not over: a, first, cut, before
    for w in C.windows(data, off, k):
        if not len(w.code):
            continue
        own, place = packed._strand(w.code, w.rc, k)
        state = table.at(place)
        low, high = state & 1 > 0, state > 1
        cut = np.zeros(len(place), bool)
        cut[cuts.at(place)] = True
        new = [w.row, off[w.row] + w.pos, w.code, w.rc, np.where(own, low, high), np.where(own, high, low), cut]
        if not kept:
            head = [new[1][:1], new[2][:1], cut[:1], np.array([-1])]
        row, at, code, rc, no_in, no_out, cut = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
        link = ~(no_out[:-1] | no_in[1:])
        link &= at[1:] - at[:-1] == 1
        link &= code[1:] != rc[:-1]
        if k == 1:  # else the first place of a row is further on
            link &= row[1:] == row[:-1]
        over = ~link
        x = np.flatnonzero(cut)
        over[x[x > 0] - 1] = True
        over[x[x < len(over)]] = True
        i = np.flatnonzero(over)
        linked = np.flatnonzero(link[i])
        after, before = np.full(len(i), -1), np.full(len(i), -1)
        after[linked], before[linked] = code[i[linked] + 1], rc[i[linked]]
        begun = [np.concatenate(x) for x in zip(head, (at[i + 1], code[i + 1], cut[i + 1], before), strict=True)]
        yield Runs(begun[0][:-1], at[i], begun[1][:-1], rc[i], begun[2][:-1], after, begun[3][:-1])
        head = [x[-1:] for x in begun]
        kept = [x[-1:] for x in (row, at, code, rc, no_in, no_out, cut)]
    if head:
        yield Runs(head[0], kept[1], head[1], kept[3], head[2], np.array([-1]), head[3])


def _found(r: Runs, x: np.ndarray, both: np.ndarray, k: int) -> pa.RecordBatch:
    """Some runs as rows of ``_OPEN``, each once with the sum of its k-mers; ``both``: letters of both strands."""
    a, b, first, last, after, before = (y[x] for y in (r.a, r.b, r.first, r.last, r.after, r.before))
    own = first < last
    ends = np.stack([np.minimum(first, last), np.maximum(first, last), np.where(own, after, before), np.where(own, before, after)])
    _, x, n = np.unique(ends, axis=1, return_index=True, return_counts=True)
    size = b[x] - a[x] + k
    start = np.where(own[x], a[x], len(both) - a[x] - size)
    kmers = size - k + 1
    return pa.RecordBatch.from_arrays([*map(pa.array, ends[:, x]), C.cut(both, start, start + size), pa.array(kmers), pa.array(n * kmers)], names=[x.split()[0] for x in _OPEN.split(", ")])


def _sent(found: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Open runs as one packed row, of kind -1, in the bucket of the first."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found[0].schema) as out:
        for batch in found:
            out.write_batch(batch)
    row = found[0].column(0)[0].as_py() >> RANGE, -1, len(found), sink.getvalue().to_pybytes(), b"", b"", b"", b""
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32()] * 3 + [pa.binary()] * 5, strict=True)], names=packed._NAMES)


def _scanned(reads: DataFrame | Texts, known: Ways) -> DataFrame:
    """All runs as packed rows."""
    k = known.k
    frame, slices = packed._source(reads, SLICE)
    pack = packed._pack_texts(2 * k)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, n, letters = [], [], 0, 0
        for part in slices(batches):
            data, off = C.buffers(part.column("seq"))
            both = np.concatenate([data, C._COMPLEMENT[data][::-1]])
            for r in _runs(data, off, known):
                opened = r.open()
                x = np.flatnonzero(~opened)
                a, b, first, last = r.a[x], r.b[x], r.first[x], r.last[x]
                size = b - a + 1
                long = np.flatnonzero(size > 1)
                start = np.where(first < last, a + k - 1, 2 * len(data) - b - 1)  # last letters of the k-mers
                held.append((np.minimum(first, last), size.astype(np.int32), packed._ragged(both, start[long], size[long])))
                n, letters = n + len(x), letters + len(held[-1][2])
                x = np.flatnonzero(opened)
                if len(x):
                    found.append(_found(r, x, both, k))
                    letters += int((r.b[x] - r.a[x] + k).sum())
                if n + C.STEP > 1 << FLUSH or letters > 4 << FLUSH:
                    if n:
                        yield pack(held)
                    if found:
                        yield _sent(found)
                    held, n, letters = [], 0, 0
        if n:
            yield pack(held)
        if found:
            yield _sent(found)

    return frame.mapInArrow(scan, packed._ROW)


def _dealt_once(rows: DataFrame) -> DataFrame:
    """The rows by bucket, shuffled here and now, so that several jobs read the same shuffle; what is lost is made again."""
    plan = rows.repartition("bucket")._jdf
    spark = rows.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.queryExecution().toRdd(), plan.schema(), False), spark)


def _closed(rows: DataFrame, k: int) -> DataFrame:
    """The unitigs that are one run, linked to no cut and none itself."""

    def whole(bucket: int, parts: Iterator[Part]) -> Iterator[pa.RecordBatch]:
        cells, held, parts = packed._space(parts)
        n, sizes = np.zeros(cells, np.int64), np.zeros(cells, np.int32)
        long: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint8))]
        for p in parts:
            before = sizes[p.keys]
            if ((before > 0) & (before != p.size)).any():
                raise RuntimeError("two unitigs begin with the same k-mer")
            n[p.keys] += p.value
            sizes[p.keys] = p.size
            x = np.flatnonzero(p.size > 1)
            new = before[x] == 0
            if new.any():
                start = np.cumsum(p.size[x]) - p.size[x]
                long.append((p.keys[x[new]], packed._ragged(p.letters, start[new], p.size[x[new]])))
        for at in packed._pieces(len(one := np.flatnonzero(sizes == 1))):
            yield _batch(C.fixed(C.letters(packed._keys(bucket, held, one[at]), k)), sizes[one[at]], n[one[at]])
        for keys, letters in long:
            size = sizes[keys].astype(np.int64)
            start = np.cumsum(size) - size
            for at in packed._pieces(len(keys), 1 << 14):
                x = keys[at]
                text = np.concatenate([C.letters(packed._keys(bucket, held, x), k).ravel(), letters[start[at[0]] : start[at[-1]] + size[at[-1]]]])
                rest = k * len(x) + start[at] - start[at[0]] + 1
                spelt = packed._ragged(text, np.stack([np.arange(len(x)) * k, rest], 1).ravel(), np.stack([np.full(len(x), k), size[at] - 1], 1).ravel())
                ends = np.cumsum(size[at] + k - 1)
                yield _batch(C.cut(spelt, ends - size[at] - k + 1, ends), sizes[x], n[x])

    return packed._ranged(rows.filter("kind >= 0"), whole, "unitig string, kmers long, n long")


def _batch(unitig: pa.Array, kmers: np.ndarray, passes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([unitig, pa.array(kmers.astype(np.int64)), pa.array(kmers * passes)], names=["unitig", "kmers", "n"])


def _open(rows: DataFrame) -> DataFrame:
    """Cuts and the runs linked to them, on the strand that is smaller, as ``_OPEN``.

    ``kmer`` and ``other`` are the codes with which the two strands begin, ``next`` and
    ``back`` those that follow on them, -1 for none; ``n`` sums the k-mers of all passes.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("low"):
                yield from pa.ipc.open_stream(x.as_buffer())

    found = rows.filter("kind < 0").select("low").mapInArrow(read, _OPEN)
    return found.groupBy("kmer").agg(*[F.max(x).alias(x) for x in ("other", "next", "back", "body", "kmers")], F.sum("n").alias("n"))


def _turned(k: int):
    """Circles, spelt from any k-mer on, from their smallest canonical k-mer on and on its strand."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, n in zip(batch.column("unitig").to_pylist(), batch.column("kmers").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                code, rc = (x.astype(np.int64) for x in C.window_codes(C._TWO[data], k))
                i = int(np.argmin(np.minimum(code, rc)))
                if code[i] > rc[i]:
                    data, i = C._COMPLEMENT[data][::-1], n - 1 - i
                out.append(data[(i + np.arange(n + k - 1)) % n].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("kmers"), batch.column("n")], names=["unitig", "kmers", "n"])

    return run


def _joined(runs: DataFrame, k: int) -> DataFrame:
    """Unitigs of the runs of ``_open``."""
    alone = runs.filter("next < 0 AND back < 0").select(F.col("body").alias("unitig"), "kmers", "n")
    some = runs.filter("next >= 0 OR back >= 0")
    here = some.select("kmer", "next", "body", "kmers", "n", F.least("kmer", "other").alias("canon"))
    there = some.select(F.col("other").alias("kmer"), F.col("back").alias("next"), S.rev_comp("body").alias("body"), "kmers", "n", F.least("kmer", "other").alias("canon"))
    nodes = scratch.cut(here.unionByName(there), "runs")
    link = nodes.filter("next >= 0").select("kmer", "next")
    chains, loops = graph.ranked(nodes.select("kmer"), link)

    def spelt(ranks: DataFrame) -> DataFrame:
        path = ranks.join(nodes.drop("next", "canon"), "kmer").groupBy("to").agg(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "body"))).alias("path"), F.sum("kmers").alias("kmers"), F.sum("n").alias("n"))
        rest = F.transform(F.slice("path", 2, 1 << 30), lambda x: F.substr(x["body"], F.lit(k)))
        return path.select(F.concat(F.col("path")[0]["body"], F.array_join(rest, "")).alias("unitig"), "kmers", "n")

    out = alone.unionByName(spelt(chains).filter(S.is_canonical("unitig")))
    if loops is not None:
        circles = spelt(graph.cut_cycles(loops, link, nodes.select("kmer", "canon")))
        out = out.unionByName(circles.mapInArrow(_turned(k), "unitig string, kmers long, n long"))
    return out


def unitigs(reads: DataFrame | Texts, k: int) -> DataFrame:
    """As ``graph.unitigs``, for odd k up to ``MAX_K``: (unitig, kmers, n)."""
    rows = _dealt_once(_scanned(reads, ways(reads, k)))
    return _closed(rows, k).unionByName(_joined(scratch.cut(_open(rows), "open"), k))
