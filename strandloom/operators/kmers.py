"""K-mer operators: counts, minimizers, anchors, junctions and the edges between them.

Reads are (read_id, seq) over ACGT. One kernel reads a sequence once and yields its
k-mers as numbers of two bits a letter, of both strands, for k up to 31, so a k-mer
costs eight bytes in a shuffle and no time that grows with its place in the read; text
is made of the few k-mers that are reported. Counts and neighbour letters combine in
the kernel's slice and before the shuffle. Windows that hold another letter than ACGT
are no k-mers. With odd k no k-mer is its own reverse complement; the smaller number
is the canonical strand, as with strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import codes as C
from strandloom.operators import packed
from strandloom.plans import scratch

#: Vertices are sent to the executors up to this many bytes (eight each), else joined.
MAX_SENT_BYTES = 32 << 20


def _dealt() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = np.frombuffer((b"ACGT" * 7)[:26], np.uint8)
    return table


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 8 MB for this session: the default holds tens of MB of texts on both sides of each running task."""
    for name, most in (("maxRecordsPerBatch", 1_000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        digits = spark.conf.get(key).rstrip("bB")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def letter_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> packed.Texts:
    """As ``letter_reads``, for operators whose tasks deal the letters themselves."""
    dealt = _dealt()
    _small_batches(docs.sparkSession)

    def turn(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = C.buffers(part.column("seq"))
        to = dealt[data]
        kept = to > 0
        ends = np.concatenate([[0], np.cumsum(kept)])[off]
        seq = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(to[kept])]).cast(pa.string())
        return pa.RecordBatch.from_arrays([part.column(0), pc.if_else(part.column("seq").is_valid(), seq, None)], names=["read_id", "seq"])

    return packed.Texts(docs.select(F.col(key).alias("read_id"), F.lower(text).alias("seq")), turn)


def letter_reads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Any table with a text column as reads: the letters a-z dealt to ACGT in turn."""
    made = letter_texts(docs, key, text)
    turn = made.turn

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "seq"):
                yield turn(part)

    kind = docs.schema[key].dataType.simpleString()
    return made.frame.mapInArrow(scan, f"read_id {kind}, seq string")


def chunks(reads: DataFrame, size: int, overlap: int) -> DataFrame:
    """Reads in chunks of at most ``size`` letters that share ``overlap`` with the next: (read_id, pos, chunk)."""
    step = size - overlap
    last = F.greatest(F.length("seq") - overlap - 1, F.lit(0))
    cut = reads.filter(F.length("seq") > 0).select("read_id", "seq", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("pos"))
    return cut.select("read_id", F.col("pos").cast("long").alias("pos"), F.substr("seq", F.col("pos") + 1, F.lit(size)).alias("chunk"))


def _id_type(reads: DataFrame) -> str:
    return reads.schema["read_id"].dataType.simpleString()


def _plain(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", "seq").filter("seq IS NOT NULL")


def codes(reads: DataFrame, k: int) -> DataFrame:
    """Every k-mer of every read as numbers: (read_id, pos, code, canon), 0-based."""
    C.check_k(k)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "seq"):
                for w in C.windows(*C.buffers(part.column("seq")), k):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(w.row)), pa.array(w.pos), pa.array(w.code), pa.array(np.minimum(w.code, w.rc))], names=["read_id", "pos", "code", "canon"])

    return _plain(reads).mapInArrow(scan, f"read_id {_id_type(reads)}, pos long, code long, canon long")


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """Every k-mer of every read as text, of any k: (read_id, pos, kmer, canon), 0-based."""
    if k <= C.MAX_K:
        return codes(reads, k).select("read_id", "pos", C.text(F.col("code"), k).alias("kmer"), C.text(F.col("canon"), k).alias("canon"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "seq"):
                for row, pos, kmer, rc, _, _ in C.text_windows(*C.buffers(part.column("seq")), k):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(pos), kmer, rc], names=["read_id", "pos", "kmer", "rc"])

    rows = _plain(reads).mapInArrow(scan, f"read_id {_id_type(reads)}, pos long, kmer string, rc string")
    return rows.select("read_id", "pos", "kmer", F.least("kmer", "rc").alias("canon"))


def code_counts(reads: DataFrame, k: int) -> DataFrame:
    """(canon, n) of the canonical codes; a slice's repeats are one row."""
    C.check_k(k)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "seq"):
                for w in C.windows(*C.buffers(part.column("seq")), k):
                    canon, n = np.unique(np.minimum(w.code, w.rc), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(canon), pa.array(n.astype(np.int64))], names=["canon", "n"])

    return _plain(reads).mapInArrow(scan, "canon long, n long").groupBy("canon").agg(F.sum("n").alias("n"))


def counts(reads: DataFrame, k: int) -> DataFrame:
    return code_counts(reads, k).select(C.text(F.col("canon"), k).alias("canon"), "n")


def spectrum(reads: DataFrame, k: int, cap: int = 200) -> DataFrame:
    """How many canonical k-mers occur n times; n above the cap as the cap."""
    return code_counts(reads, k).groupBy(F.least("n", F.lit(cap)).cast("long").alias("n")).agg(F.count("*").alias("kmers"))


def minimizer_codes(reads: DataFrame, k: int, w: int) -> DataFrame:
    """(read_id, pos, code): see ``minimizers``; one pass over the reads, no shuffle."""
    C.check_k(k)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "seq"):
                for row, pos, low in C.minimizers(*C.buffers(part.column("seq")), k, w):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(pos), pa.array(low)], names=["read_id", "pos", "code"])

    return _plain(reads).mapInArrow(scan, f"read_id {_id_type(reads)}, pos long, code long")


def minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """Smallest canonical k-mer of every full window of ``w`` k-mers, where it changes: (read_id, pos, minimizer); ``pos`` starts the window."""
    return minimizer_codes(reads, k, w).select("read_id", "pos", C.text(F.col("code"), k).alias("minimizer"))


def anchor_codes(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """Every w-th inner k-mer position of each sequence, the first one of a k-mer: (canon, read_id, pos, forward)."""
    n = F.length("seq") - k
    last = seqs.select("read_id", n.alias("n"))
    inner = codes(seqs, k).filter((F.col("pos") % w == 0) & (F.col("pos") > 0)).join(last, "read_id").filter(F.col("pos") < F.col("n"))
    return inner.groupBy("canon").agg(F.min(F.struct("read_id", "pos", (F.col("code") == F.col("canon")).alias("forward"))).alias("a")).select("canon", "a.*")


def anchors(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """``anchor_codes`` with the k-mers as text."""
    return anchor_codes(seqs, k, w).withColumn("canon", C.text(F.col("canon"), k))


def strand_nodes(reads: DataFrame, k: int) -> DataFrame:
    """As ``nodes``, up to k = 31 of the canonical strand alone, so that half as many rows are shuffled. A slice's repeats are one row."""
    small = k <= C.MAX_K

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "seq"):
                data, off = C.buffers(part.column("seq"))
                if small:
                    for w in C.windows(data, off, k):
                        here, there = C.masks(w.prev, w.next)
                        mask = np.where(w.code < w.rc, here, np.where(w.code > w.rc, there, here | there))
                        cols = C.combine(np.minimum(w.code, w.rc), np.maximum(w.code, w.rc), mask)
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, ("i8", "i8", "i4", "i8"), strict=True)], names=["kmer", "rc", "mask", "n"])
                else:
                    for _, _, kmer, rc, prev, after in C.text_windows(data, off, k):
                        for a, b, mask in zip((kmer, rc), (rc, kmer), C.masks(prev, after), strict=True):
                            yield pa.RecordBatch.from_arrays([a, b, pa.array(mask.astype(np.int32)), pa.array(np.ones(len(a), np.int64))], names=["kmer", "rc", "mask", "n"])

    kind = "long" if small else "string"
    return _plain(reads).mapInArrow(scan, f"kmer {kind}, rc {kind}, mask int, n long").groupBy("kmer", "rc").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))


#: A mask as the other strand has it: its eight bits in reverse.
_MIRROR = [int(f"{m:08b}"[::-1], 2) for m in range(256)]


def nodes(reads: DataFrame, k: int) -> DataFrame:
    """Every k-mer of both strands: (kmer, rc, mask, n).

    ``mask`` has the letters seen before it (low four bits, A C G T) and after it,
    ``n`` its occurrences. k-mers are codes up to k = 31 and text beyond.
    """
    rows = strand_nodes(reads, k)
    return both_strands(rows) if k <= C.MAX_K else rows


def both_strands(rows: DataFrame) -> DataFrame:
    """Canonical rows (kmer, rc, mask, n) with those of the other strand; a k-mer that is its own counts twice."""
    own = F.col("kmer") == F.col("rc")
    other = F.struct(F.col("rc").alias("kmer"), F.col("kmer").alias("rc"), F.element_at(F.lit(_MIRROR), F.col("mask") + 1).cast("int").alias("mask"), F.col("n").alias("n"))
    here = F.struct("kmer", "rc", "mask", F.when(own, 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
    return rows.select(F.explode(F.when(own, F.array(here)).otherwise(F.array(here, other))).alias("x")).select("x.*")


def only_letter(low: int) -> Column:
    """The place in ACGT of the single letter of a mask's four bits from bit ``low`` on; null if there are none or several."""
    bits = F.shiftright(F.col("mask"), low).bitwiseAND(15)
    return F.when(F.bit_count(bits) == 1, F.log2(bits).cast("int"))


def neighbours(reads: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers of both strands with each letter before and after: (kmer, prev, next), one side of a row filled."""
    seen = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.struct(F.lit(c if i < 4 else None).cast("string").alias("prev"), F.lit(c if i >= 4 else None).cast("string").alias("next"))) for i, c in enumerate("ACGT" * 2)]
    sides = F.filter(F.array(*seen), lambda x: x.isNotNull())
    return nodes(reads, k).select(_text(k).alias("kmer"), F.explode_outer(sides).alias("s")).select("kmer", "s.prev", "s.next")


def _text(k: int) -> Column:
    return C.text(F.col("kmer"), k) if k <= C.MAX_K else F.col("kmer")


def _junctions(reads: DataFrame, k: int) -> DataFrame:
    degrees = [F.bit_count(F.col("mask").bitwiseAND(m)).cast("long") for m in (15, 240)]
    rows = strand_nodes(reads, k).filter((degrees[0] != 1) | (degrees[1] != 1))  # alike on both strands
    rows = both_strands(rows) if k <= C.MAX_K else rows
    return rows.select("kmer", degrees[0].alias("in_deg"), degrees[1].alias("out_deg"))


def junction_codes(reads: DataFrame, k: int) -> DataFrame:
    """K-mers of both strands without exactly one letter before and one after: (code, in_deg, out_deg)."""
    C.check_k(k)
    return _junctions(reads, k).withColumnRenamed("kmer", "code")


def junctions(reads: DataFrame, k: int) -> DataFrame:
    """``junction_codes`` with the k-mers as text: (kmer, in_deg, out_deg)."""
    return _junctions(reads, k).withColumn("kmer", _text(k))


def tie_ends(reads: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """(code): the canonical codes of ``vertices`` with those of the reads' first and last k-mers, so that every read begins and ends at one."""
    long = reads.filter(F.length("seq") >= k)
    ends = long.select(F.explode(F.array(F.left("seq", F.lit(k)), F.right("seq", F.lit(k)))).alias("seq")).distinct()
    return vertices.select("code").unionByName(codes(ends.withColumn("read_id", F.lit(0)), k).select(F.col("canon").alias("code"))).distinct()


def _vertex_codes(vertices: DataFrame, k: int) -> DataFrame:
    known = vertices.select("code") if "code" in vertices.columns else vertices.select(C.code(F.col("kmer")).alias("code"))
    return scratch.cut(known.distinct(), "vertices")


def _sent(vertices: DataFrame, max_bytes: int) -> np.ndarray | None:
    """All codes in order if they may be sent, by their number."""
    if 8 * vertices.count() > max_bytes:
        return None
    return np.sort(vertices.toArrow().column("code").to_numpy())


def _held(codes: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, codes)
    return np.flatnonzero(among[np.minimum(at, len(among) - 1)] == codes) if len(among) else at[:0]


def hit_codes(reads: DataFrame, vertices: DataFrame, k: int, max_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """Positions of the reads' k-mers that are vertices (column code or kmer): (read_id, pos, code).

    The vertices are sent to the executors if their counted number allows it, else
    all k-mers meet them in a join.
    """
    known = _vertex_codes(vertices, k)
    sent = _sent(known, max_bytes)
    if sent is None:
        return codes(reads, k).select("read_id", "pos", "code").join(known, "code", "left_semi").select("read_id", "pos", "code")
    table = reads.sparkSession.sparkContext.broadcast(sent)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "seq"):
                for w in C.windows(*C.buffers(part.column("seq")), k):
                    at = _held(w.code, table.value)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(w.row[at])), pa.array(w.pos[at]), pa.array(w.code[at])], names=["read_id", "pos", "code"])

    return _plain(reads).mapInArrow(scan, f"read_id {_id_type(reads)}, pos long, code long")


def hits(reads: DataFrame, vertices: DataFrame | packed.Junctions, k: int) -> DataFrame:
    """``hit_codes`` with the k-mers as text: (read_id, pos, kmer)."""
    if isinstance(vertices, packed.Junctions):
        return packed.hits(reads, vertices)
    return hit_codes(reads, vertices, k).select("read_id", "pos", C.text(F.col("code"), k).alias("kmer"))


_LINK = "pos long, src string, dst string, label string"


def _cut_links(ids: pa.Array, data: np.ndarray, row: np.ndarray, pos: np.ndarray, off: np.ndarray, k: int) -> pa.RecordBatch:
    """Links between neighbouring hits (in order) of a row."""
    at = np.flatnonzero(row[1:] == row[:-1])
    a, b = off[row[at]] + pos[at], off[row[at + 1]] + pos[at + 1]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row[at])), pa.array(pos[at]), C.cut(data, a, a + k), C.cut(data, b, b + k), C.cut(data, a + k, b + k)], names=["read_id", "pos", "src", "dst", "label"])


def links(reads: DataFrame, vertices: DataFrame | packed.Junctions, k: int, max_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """Consecutive vertex hits of each read: (read_id, pos, src, dst, label); the label is what the step adds.

    One pass over the reads if the vertices can be sent; else each read gets its hits
    by a join and its labels are cut where the read is, so no letter moves twice.
    """
    if isinstance(vertices, packed.Junctions):
        return packed.links(reads, vertices)
    known = _vertex_codes(vertices, k)
    sent = _sent(known, max_bytes)
    schema = f"read_id {_id_type(reads)}, {_LINK}"
    if sent is None:
        held = codes(reads, k).select("read_id", "pos", "code").join(known, "code", "left_semi").groupBy("read_id").agg(F.sort_array(F.collect_list("pos")).alias("at"))

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in C.slices(batch, "seq"):
                    data, off = C.buffers(part.column("seq"))
                    at = part.column("at")
                    row = np.repeat(np.arange(part.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
                    yield _cut_links(part.column(0), data, row, at.flatten().to_numpy(zero_copy_only=False), off, k)

        return _plain(reads).join(held, "read_id").select("read_id", "seq", "at").mapInArrow(cut, schema)
    table = reads.sparkSession.sparkContext.broadcast(sent)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "seq"):
                data, off = C.buffers(part.column("seq"))
                row, pos = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for w in C.windows(data, off, k):
                    at = _held(w.code, table.value)
                    row, pos = np.append(row, w.row[at]), np.append(pos, w.pos[at])
                    yield _cut_links(part.column(0), data, row, pos, off, k)
                    row, pos = row[-1:], pos[-1:]  # the next link begins here

    return _plain(reads).mapInArrow(scan, schema)


def edges(reads: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """Distinct links with the number of reads' passes: (src, dst, label, n)."""
    return links(reads, vertices, k).groupBy("src", "dst", "label").agg(F.count("*").alias("n"))
