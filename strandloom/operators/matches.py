"""Partial exact matches of reads on a graph's edges, for reads that leave the graph in places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import kmers


def partial_matches(reads: DataFrame, vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(read_id, pos_from, pos_to, src, dst, edge_from, edge_to): stretches of reads that follow an edge from a vertex, or up to one.

    ``vertices``: code; ``edges``: src, dst, label (what the edge adds to src), of which
    no two of a vertex begin with the same letter, or end before it with the same one.
    From each vertex hit the read is followed along the edge of its next letter as far
    as letters agree; backwards only from hits that the stretch before did not reach.
    Places count the k-mers' starts. The text between hits is cut where the reads are;
    of a read itself only the parts before the first and behind the last hit are joined.
    """
    e = edges.select("src", "dst", "label").distinct()
    found = kmers.hits(reads, vertices, k)
    outer = found.groupBy("read_id").agg(F.min(F.struct("pos", "kmer")).alias("a"), F.max(F.struct("pos", "kmer")).alias("b")).join(reads.select("read_id", "seq"), "read_id")
    heads = outer.select("read_id", "a.pos", "a.kmer", F.left("seq", F.col("a.pos").cast("int")).alias("before"))
    tails = outer.select("read_id", "b.pos", "b.kmer", F.substr("seq", F.col("b.pos") + k + 1, F.length("seq")).alias("piece"), F.lit(None).cast("string").alias("next"))
    inner = kmers.links(reads, vertices, k).select("read_id", "pos", F.col("src").alias("kmer"), F.col("label").alias("piece"), F.col("dst").alias("next"))
    on = inner.unionByName(tails).withColumn("letter", F.left("piece", F.lit(1)))
    ahead = e.select(F.col("src").alias("kmer"), F.left("label", F.lit(1)).alias("letter"), "src", "dst", "label")
    followed = on.join(ahead, ["kmer", "letter"], "left").withColumn("n", F.when(F.col("label").isNull(), F.lit(0).cast("long")).otherwise(S.common_prefix("label", "piece")))
    forward = followed.filter("n > 0").select("read_id", F.col("pos").alias("pos_from"), (F.col("pos") + F.col("n")).alias("pos_to"), "src", "dst", F.lit(0).cast("long").alias("edge_from"), F.col("n").alias("edge_to"))
    missed = followed.filter(F.col("next").isNotNull() & (F.col("n") < F.length("piece"))).select("read_id", (F.col("pos") + F.length("piece")).alias("pos"), F.col("next").alias("kmer"), F.left(F.concat("kmer", "piece"), F.length("piece")).alias("before"))
    open_ = missed.unionByName(heads.filter("pos > 0")).withColumn("letter", F.right("before", F.lit(1)))
    text = F.left(F.concat("src", "label"), F.length("label"))
    behind = e.select(F.col("dst").alias("kmer"), F.right(text, F.lit(1)).alias("letter"), "src", "dst", text.alias("text"))
    back = open_.join(behind, ["kmer", "letter"]).withColumn("n", S.common_prefix(F.reverse("text"), F.reverse("before")))
    size = F.length("text").cast("long")
    backward = back.select("read_id", (F.col("pos") - F.col("n")).alias("pos_from"), F.col("pos").alias("pos_to"), "src", "dst", (size - F.col("n")).alias("edge_from"), size.alias("edge_to"))
    return forward.unionByName(backward)
