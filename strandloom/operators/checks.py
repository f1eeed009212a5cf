"""Selections and checks on edges, paths and contigs: prefixes, order, uniqueness, validity, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S


def rank_by_length(seqs: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, size, place): longest first, ties by sequence and key; places come from counts by length, not from one sorted task."""
    sized = seqs.select(key, "seq", F.length("seq").cast("long").alias("size"))
    counts = sized.groupBy("size").agg(F.count("*").alias("n"))
    larger = counts.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a length
    at = F.row_number().over(Window.partitionBy("size").orderBy("seq", key))
    return sized.withColumn("at", at).join(larger, "size").select(key, "size", (F.col("at") + F.col("above")).cast("long").alias("place"))


def sorted_out_edges(edges: DataFrame) -> DataFrame:
    """(src, label, place, common): a vertex' edges by label, with the letters shared with the one before."""
    by = Window.partitionBy("src").orderBy("label")
    e = edges.select("src", "label").distinct().withColumns({"place": F.row_number().over(by).cast("long"), "__before": F.lag("label").over(by)})
    return e.select("src", "label", "place", F.when(F.col("__before").isNull(), 0).otherwise(S.common_prefix("__before", "label")).cast("long").alias("common"))


def merge_prefixes(edges: DataFrame) -> DataFrame:
    """(src, label): without labels that begin another label of the vertex; in sorted order that is the next one."""
    after = F.lead("label").over(Window.partitionBy("src").orderBy("label"))
    e = edges.select("src", "label").distinct().withColumn("__after", after)
    return e.filter(F.col("__after").isNull() | ~F.startswith("__after", F.col("label"))).select("src", "label")


def tournament(candidates: DataFrame, least: int = 20, share: int = 100) -> DataFrame:
    """(group_id, winner, dist): the candidate nearest to the target, if no other near one lies elsewhere.

    ``candidates``: group_id, cand_id, target, seq. The winner's edit distance is at
    most ``max(least, length of target / share)``, ties by cand_id; every other
    candidate nearer than that must lie behind the winner (its distance is the
    winner's and the one between them), else the group has no winner.
    """
    allowed = F.greatest(F.lit(least), F.floor(F.length("target") / share))
    d = candidates.withColumns({"dist": F.levenshtein("target", "seq"), "allowed": allowed})
    win = d.groupBy("group_id").agg(F.min(F.struct("dist", "cand_id", "seq")).alias("w"))
    near = d.join(win, "group_id").withColumn("apart", F.levenshtein(F.col("w.seq"), F.col("seq")))
    bad = (F.col("cand_id") != F.col("w.cand_id")) & (F.col("dist") < F.col("allowed")) & (F.col("dist") != F.col("w.dist") + F.col("apart"))
    found = near.groupBy("group_id").agg(F.first("w").alias("w"), F.max("allowed").alias("allowed"), F.max(bad.cast("int")).alias("bad"))
    return found.filter((F.col("w.dist") <= F.col("allowed")) & (F.col("bad") == 0)).select("group_id", F.col("w.cand_id").alias("winner"), F.col("w.dist").cast("long").alias("dist"))


def unique_links(contigs: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(left, right): contigs of which one ends with the k letters that the other starts with, where those letters start one contig and end one only."""
    long = contigs.filter(F.length("seq") >= k)
    ends = long.groupBy(F.right("seq", F.lit(k)).alias("mer")).agg(F.count("*").alias("n"), F.min(key).alias("left")).filter("n = 1")
    starts = long.groupBy(F.left("seq", F.lit(k)).alias("mer")).agg(F.count("*").alias("n"), F.min(key).alias("right")).filter("n = 1")
    return ends.select("mer", "left").join(starts.select("mer", "right"), "mer").select("left", "right")


def subgraph_edges(seqs: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """(src, dst, seq): both strands of the segments [left, right) of the sequences; vertices are their end k-mers."""
    cut = segments.join(seqs, "read_id").select(F.substr("seq", F.col("left") + 1, F.col("right") - F.col("left")).alias("seq")).filter(F.length("seq") > k)
    both = cut.unionByName(cut.select(S.rev_comp("seq").alias("seq"))).distinct()
    return both.select(F.left("seq", F.lit(k)).alias("src"), F.right("seq", F.lit(k)).alias("dst"), "seq")


def violations(edges: DataFrame) -> DataFrame:
    """(check, n): edges (src, dst, label) that break a rule of a graph of both strands.

    ``end``: the label does not end as the end vertex does; ``letter``: another edge of
    the vertex begins with the same letter; ``twin``: the reverse complement is no edge.
    """
    e = edges.select("src", "dst", "label").distinct().withColumn("whole", F.concat("src", "label"))
    size = F.least(F.length("dst"), F.length("label"))
    end = e.filter(F.right("label", size) != F.right("dst", size)).agg(F.count("*").alias("n")).select(F.lit("end").alias("check"), "n")
    letter = e.groupBy("src", F.left("label", F.lit(1)).alias("a")).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).cast("long").alias("n")).select(F.lit("letter").alias("check"), "n")
    twin = e.join(e.select(S.rev_comp("whole").alias("whole")), "whole", "left_anti").agg(F.count("*").alias("n")).select(F.lit("twin").alias("check"), "n")
    return end.unionByName(letter).unionByName(twin)


def lonely_edges(paths: DataFrame) -> DataFrame:
    """(eid): edges that no path of two steps or more goes through."""
    long = paths.groupBy("path_id").agg(F.count("*").alias("n")).filter("n > 1").select("path_id")
    busy = paths.join(long, "path_id", "left_semi").select("eid").distinct()
    return paths.select("eid").distinct().join(busy, "eid", "left_anti")


def trim_ends(paths: DataFrame, low: DataFrame) -> DataFrame:
    """(path_id, ord, eid): paths without the ``low`` edges (column eid) at their ends; those that hold one inside go."""
    marked = paths.join(low.select("eid", F.lit(True).alias("__low")), "eid", "left").withColumn("__low", F.coalesce("__low", F.lit(False)))
    span = marked.groupBy("path_id").agg(F.min(F.when(~F.col("__low"), F.col("ord"))).alias("__a"), F.max(F.when(~F.col("__low"), F.col("ord"))).alias("__b"))
    inner = marked.join(span, "path_id").filter((F.col("ord") >= F.col("__a")) & (F.col("ord") <= F.col("__b")))
    bad = inner.filter("__low").select("path_id").distinct()
    return inner.join(bad, "path_id", "left_anti").select("path_id", "ord", "eid")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path_id, ord, first, second): the steps of two tables of paths side by side, as far as both go."""
    return a.select("path_id", "ord", F.col("eid").alias("first")).join(b.select("path_id", "ord", F.col("eid").alias("second")), ["path_id", "ord"])


def ends_of_long(seqs: DataFrame, longer_than: int, kept: int) -> DataFrame:
    """(read_id, part, seq): sequences over a length as their first and last letters, others whole."""
    parts = F.when(F.length("seq") > longer_than, F.array(F.struct(F.lit("start").alias("part"), F.left("seq", F.lit(kept)).alias("seq")), F.struct(F.lit("end").alias("part"), F.right("seq", F.lit(kept)).alias("seq"))))
    return seqs.select("read_id", F.explode(F.coalesce(parts, F.array(F.struct(F.lit("whole").alias("part"), F.col("seq").alias("seq"))))).alias("p")).select("read_id", "p.part", "p.seq")


def breaks(segments: DataFrame, key: str) -> DataFrame:
    """(key, pieces, breaks): consecutive segments [left, right) of each key, and where one does not go on where the last ended."""
    by = Window.partitionBy(key).orderBy("left", "right")
    off = (F.lead("left").over(by) != F.col("right")).cast("long")
    return segments.withColumn("__off", F.coalesce(off, F.lit(0))).groupBy(key).agg(F.count("*").alias("pieces"), F.sum("__off").alias("breaks"))


def audit(before: DataFrame, after: DataFrame, letter: Column | None = None) -> DataFrame:
    """(path_id, was, now, state): each path's compact form before and after a correction; initial, rerouted or invalidated."""
    from strandloom.operators import paths

    old, new = (paths.compact(x).select("path_id", "letters") for x in (before, after))
    both = old.withColumnRenamed("letters", "was").join(new.withColumnRenamed("letters", "now"), "path_id", "left")
    return both.withColumn("state", F.when(F.col("now").isNull(), "invalidated").when(F.col("now") != F.col("was"), "rerouted").otherwise("initial"))


def save_coverage(edges: DataFrame, path: str) -> None:
    """The edges' coverage (eid, cov) as a table."""
    edges.select("eid", "cov").write.parquet(path)


def load_coverage(edges: DataFrame, path: str) -> DataFrame:
    """``edges`` with the coverage that was saved; edges without one have 0."""
    saved = edges.sparkSession.read.parquet(path)
    return edges.drop("cov").join(saved, "eid", "left").withColumn("cov", F.coalesce("cov", F.lit(0)))


