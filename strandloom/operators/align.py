"""Exact threading of reads through a graph whose edges are whole strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import kmers


def both_strands(unitigs: DataFrame, k: int) -> DataFrame:
    """Edges (eid, src, dst, seq, len, cov) of both strands; vertices are their end k-mers.

    ``unitigs``: unitig, kmers, n, one strand each, of (k + 1)-mers. The edge's key is its
    string, its id a hash of it; ``cov`` is the mean count of its (k + 1)-mers.
    """
    rc = unitigs.withColumn("unitig", S.rev_comp("unitig"))
    both = unitigs.unionByName(rc).dropDuplicates(["unitig"])
    s = F.col("unitig")
    return both.select(F.xxhash64(s).alias("eid"), F.left(s, F.lit(k)).alias("src"), F.right(s, F.lit(k)).alias("dst"), s.alias("seq"), (F.length(s) - k).cast("long").alias("len"), (F.col("n") / F.col("kmers")).alias("cov"))


def index(edges: DataFrame, k: int) -> DataFrame:
    """(kmer, eid, epos): every (k + 1)-mer of every edge."""
    return kmers.kmers(edges.select(F.col("eid").alias("read_id"), "seq"), k + 1).select("kmer", F.col("read_id").alias("eid"), F.col("pos").alias("epos"))


def thread(reads: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(path_id, piece, ord, eid, left, right): each read's edges in order, with the letters [left, right) of the edge's steps it takes.

    A read that leaves an edge and comes back on the same diagonal has stayed on it;
    where it leaves the graph otherwise, its path is cut and a new piece begins.
    """
    hit = kmers.kmers(reads, k + 1).select("read_id", "pos", "kmer").join(index(edges, k), "kmer")
    by = Window.partitionBy("read_id").orderBy("pos")
    diagonal = F.col("pos") - F.col("epos")
    same = (F.lag("eid").over(by) == F.col("eid")) & (F.lag(diagonal).over(by) == diagonal)
    runs = hit.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    steps = runs.groupBy("read_id", "run").agg(F.min("pos").alias("at"), F.first("eid").alias("eid"), F.min("epos").alias("left"), (F.max("epos") + 1).alias("right"))
    order = Window.partitionBy("read_id").orderBy("at")
    size = edges.select("eid", "src", "dst", F.col("len").alias("size"))
    last = steps.join(size, "eid").withColumns({"to": F.lag("dst").over(order), "open": F.lag(F.col("right") < F.col("size")).over(order), "end": F.lag(F.col("at") + F.col("right") - F.col("left")).over(order)})
    cut = F.col("to").isNotNull() & (F.col("open") | (F.col("left") > 0) | (F.col("to") != F.col("src")) | (F.col("end") != F.col("at")))
    pieces = last.withColumn("piece", F.sum(F.when(cut, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.row_number().over(Window.partitionBy("read_id", "piece").orderBy("at")).cast("long")
    return pieces.select(F.col("read_id").alias("path_id"), "piece", number.alias("ord"), "eid", "left", "right")


def spell(paths: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(path_id, piece, seq): the letters of each piece of a path."""
    parts = paths.join(edges.select("eid", "seq"), "eid")
    first = F.col("ord") == 1
    text = F.when(first, F.substr("seq", F.col("left") + 1, F.col("right") - F.col("left") + k)).otherwise(F.substr("seq", F.col("left") + k + 1, F.col("right") - F.col("left")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), "")
    return parts.groupBy("path_id", "piece").agg(joined.alias("seq"))


def edge_coverage(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(eid, cov): covered steps over the edge's length."""
    sums = paths.groupBy("eid").agg(F.sum(F.col("right") - F.col("left")).alias("covered"))
    return edges.select("eid", "len").join(sums, "eid", "left").select("eid", (F.coalesce("covered", F.lit(0)) / F.col("len")).alias("cov"))


def simplify(edges: DataFrame, k: int, min_cov: float) -> DataFrame:
    """Edges after those of little coverage are dropped and the rest is compacted again: a graph on the kept strings."""
    from strandloom.operators import graph

    kept = edges.filter(F.col("cov") >= min_cov).select("src", "dst", "seq")
    # an edge and the next one share only their vertex: spell the step over it too
    out = kept.select(F.col("src").alias("dst"), F.substr("seq", F.lit(k + 1), F.lit(1)).alias("letter"))
    over = kept.join(out, "dst").select(F.concat(F.right("seq", F.lit(k + 1)), "letter").alias("seq"))
    strings = kept.select("seq").unionByName(over).select(F.xxhash64("seq").alias("read_id"), "seq")
    again = graph.unitigs(strings, k + 1).select("unitig", "kmers")
    # coverage of the new strings: the old coverage of their (k + 1)-mers
    old = index(edges, k).join(edges.select("eid", "cov"), "eid").select("kmer", "cov")
    new = kmers.kmers(again.select(F.col("unitig").alias("read_id"), F.col("unitig").alias("seq")), k + 1).join(old, "kmer").groupBy(F.col("read_id").alias("unitig")).agg(F.sum("cov").alias("n"))
    return both_strands(again.join(new, "unitig"), k)
