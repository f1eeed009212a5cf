"""Polishing: run-length votes of aligned reads, their medians, consensus of complex regions, uncompressed contigs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import kernels as N
from strandloom.functions import seq as S

MAX_VOTES, MAX_STRINGS, MAX_RUN = 21, 25, 255


def run_lengths(seqs: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, pos, letter, run): the runs of each sequence, positions in compressed coordinates."""
    starts = seqs.select(key, "seq", F.posexplode(S.run_starts("seq")).alias("pos", "at"))
    by = Window.partitionBy(key).orderBy("pos")
    run = F.coalesce(F.lead("at").over(by), F.length("seq")) - F.col("at")
    return starts.select(key, F.col("pos").cast("long").alias("pos"), F.substr("seq", F.col("at") + 1, F.lit(1)).alias("letter"), F.least(run, F.lit(MAX_RUN)).cast("long").alias("run"))


def votes(reads: DataFrame, alignments: DataFrame) -> DataFrame:
    """(contig_id, pos, read_id, run): each read's run length at every contig position its exact matches cover.

    ``alignments``: read_id, contig_id, r_from, r_to, c_from on compressed sequences.
    """
    runs = run_lengths(reads)
    hit = runs.join(alignments, "read_id").filter((F.col("r_from") <= F.col("pos")) & (F.col("pos") < F.col("r_to")))
    return hit.select("contig_id", (F.col("c_from") + F.col("pos") - F.col("r_from")).alias("pos"), "read_id", "run")


def median_runs(vote_rows: DataFrame) -> DataFrame:
    """(contig_id, pos, n, run): slot (1 + n) div 2 of the first 21 sorted votes, by read id."""
    by = Window.partitionBy("contig_id", "pos").orderBy("read_id", "run")
    first = vote_rows.withColumn("__k", F.row_number().over(by)).filter(F.col("__k") <= MAX_VOTES)
    c = first.groupBy("contig_id", "pos").agg(F.sort_array(F.collect_list("run")).alias("v"), F.count("*").alias("n"))
    return c.select("contig_id", "pos", "n", F.element_at("v", F.expr("cast((1 + n) div 2 as int)")).alias("run"))


def uncompress(contigs: DataFrame, runs: DataFrame) -> DataFrame:
    """(contig_id, seq): each compressed letter as often as its run says; once where nothing is known."""
    letters = contigs.select("contig_id", F.posexplode(F.split("seq", "")).alias("pos", "letter")).filter("letter <> ''")
    known = letters.join(runs.select("contig_id", "pos", "run"), ["contig_id", "pos"], "left")
    text = F.repeat("letter", F.coalesce("run", F.lit(1)).cast("int"))
    return known.groupBy("contig_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "").alias("seq"))


def complex_regions(contigs: DataFrame, min_pairs: int = 10, margin: int = 5) -> DataFrame:
    """(contig_id, left, right): surroundings of dinucleotide repeats, merged where they meet."""
    from strandloom.operators import intervals

    r = contigs.select("contig_id", F.length("seq").alias("n"), F.explode(N.dinucleotide_repeats_col(F.col("seq"), min_pairs)).alias("r"))
    cut = r.select("contig_id", F.greatest(F.col("r.start") - margin, F.lit(0)).alias("left"), F.least(F.col("r.start") + 2 * F.col("r.pairs") + margin, F.col("n")).cast("long").alias("right"))
    return intervals.union(cut, "contig_id").drop("n")


def _align(graph_seq: str, s: str) -> list[tuple[int, int]]:
    """Pairs of equal or substituted positions of the best global alignment."""
    i = j = 0
    out = []
    for op, n in N.banded_cigar(graph_seq, s, 10, 8, 0, 8, 50):
        if op == "M":
            out += [(i + x, j + x) for x in range(n)]
        i, j = i + n * (op != "I"), j + n * (op != "D")
    return out


def consensus(strings: list[str], size: int | None = None) -> str:
    """Consensus of similar strings: votes on the columns of alignments to the one of median length, and on what stands between.

    Strings more than a tenth longer or shorter than the median are left out, at most
    25 are used in order; ends that fewer than half support are trimmed. ``size``: the
    median length, if the strings were chosen by it already.
    """
    if not strings:
        return ""
    size = sorted(map(len, strings))[len(strings) // 2] if size is None else size
    used = [s for s in strings if abs(len(s) - size) * 10 <= size][:MAX_STRINGS]
    if not used:
        return ""
    core = min(used, key=lambda s: (abs(len(s) - size), used.index(s)))
    for _ in range(2):
        letter = [Counter() for _ in core]
        between = [Counter() for _ in range(len(core) + 1)]
        cover = np.zeros(len(core), int)
        for s in used:
            pairs = _align(core, s)
            at, last = 0, -1
            for i, j in pairs:
                for g in range(last + 1, i):
                    letter[g][""] += 1
                letter[i][s[j]] += 1
                between[i][s[at:j]] += 1
                cover[i] += 1
                at, last = j + 1, i
            between[last + 1][s[at:]] += 1
        keep = np.flatnonzero(2 * cover >= len(used))
        if not len(keep):
            return core
        out = []
        for i in range(keep[0], keep[-1] + 1):
            if i > keep[0]:
                gap, n = between[i].most_common(1)[0] if between[i] else ("", 0)
                out.append(gap if 2 * n > len(used) else "")
            out.append(max(letter[i].items(), key=lambda x: (x[1], x[0]))[0])
        new = "".join(out)
        if new == core:
            break
        core = new
    return core


def region_consensus(pieces: DataFrame) -> DataFrame:
    """(contig_id, left, right, seq) from the reads' strings over each region: contig_id, left, right, read_id, part."""

    region = ["contig_id", "left", "right"]

    def solve(table: pa.Table) -> pa.Table:
        t = table.sort_by([("read_id", "ascending"), ("part", "ascending")])
        one = {k: t.column(k)[:1].combine_chunks() for k in region}
        return pa.table({**one, "seq": pa.array([consensus(t.column("part").to_pylist(), t.column("size")[0].as_py())], pa.string())})

    size = F.length("part")
    by_size, by_read = Window.partitionBy(*region).orderBy(size), Window.partitionBy(*region).orderBy("read_id", "part")
    # the median length of all strings, then the first ones that fit it
    placed = pieces.withColumns({"__k": F.row_number().over(by_size), "__n": F.count("*").over(Window.partitionBy(*region))})
    median = placed.filter(F.col("__k") == F.floor(F.col("__n") / 2) + 1).select(*region, size.cast("long").alias("size"))
    fit = pieces.join(median, region).filter(F.abs(size - F.col("size")) * 10 <= F.col("size"))
    few = fit.withColumn("__k", F.row_number().over(by_read)).filter(F.col("__k") <= MAX_STRINGS).select("contig_id", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.col("read_id").cast("string").alias("read_id"), "part", "size")
    return few.groupBy(*region).applyInArrow(solve, f"contig_id {pieces.schema['contig_id'].dataType.simpleString()}, left long, right long, seq string")
