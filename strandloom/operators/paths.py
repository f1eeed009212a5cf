"""Path operators: tables (path_id, ord, eid) with their transitions, suffix counts and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by():
    return Window.partitionBy("path_id").orderBy("ord")


def transitions(paths: DataFrame) -> DataFrame:
    """(e1, e2, n): how often an edge follows another."""
    steps = paths.select(F.col("eid").alias("e1"), F.lead("eid").over(_by()).alias("e2"))
    return steps.filter("e2 IS NOT NULL").groupBy("e1", "e2").agg(F.count("*").alias("n"))


def as_lists(paths: DataFrame) -> DataFrame:
    """(path_id, eids): each path as an array."""
    return paths.groupBy("path_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "eid"))), lambda x: x["eid"]).alias("eids"))


def as_rows(lists: DataFrame) -> DataFrame:
    return lists.select("path_id", F.posexplode("eids").alias("ord", "eid")).select("path_id", (F.col("ord") + 1).cast("long").alias("ord"), "eid")


def suffixes(paths: DataFrame, max_len: int, letter: Column | None = None) -> DataFrame:
    """(eid, letters, n): the paths that start at each step, cut to ``max_len`` letters, with counts."""
    letter = F.left("eid", F.lit(1)) if letter is None else letter
    after = [F.coalesce(F.lead(letter, i).over(_by()), F.lit("")) if i else letter for i in range(max_len)]
    return paths.select("eid", F.concat(*after).alias("letters")).groupBy("eid", "letters").agg(F.count("*").alias("n"))


def prefix_support(suffix_counts: DataFrame, max_len: int) -> DataFrame:
    """(eid, prefix, n): how many stored suffixes start with each prefix."""
    rows = suffix_counts.select("eid", "n", "letters", F.explode(F.sequence(F.lit(1), F.least(F.length("letters"), F.lit(max_len)))).alias("size"))
    return rows.groupBy("eid", F.left("letters", F.col("size")).alias("prefix")).agg(F.sum("n").cast("long").alias("n"))


def unique_extension(support: DataFrame, min_good: int, max_bad: int) -> DataFrame:
    """(eid, prefix, letter): the only letter that goes on, all others having at most ``max_bad`` support."""
    step = support.filter(F.length("prefix") > 1).select("eid", F.expr("left(prefix, length(prefix) - 1)").alias("prefix"), F.right("prefix", F.lit(1)).alias("letter"), "n")
    good = step.groupBy("eid", "prefix").agg(F.sum((F.col("n") >= min_good).cast("int")).alias("good"), F.sum((F.col("n") > max_bad).cast("int")).alias("more"), F.max(F.struct("n", "letter")).alias("top"))
    return good.filter("good = 1 AND more = 1").select("eid", "prefix", F.col("top.letter").alias("letter"))


def remove_edge(paths: DataFrame, eid) -> DataFrame:
    """The paths without the edge, renumbered."""
    left = paths.filter(F.col("eid") != eid)
    return left.select("path_id", F.row_number().over(_by()).cast("long").alias("ord"), "eid")


def add_between(paths: DataFrame, left, right, new) -> DataFrame:
    """``new`` between each neighbouring ``left`` and ``right``."""
    nxt = F.lead("eid").over(_by())
    both = paths.withColumn("next", nxt).select("path_id", "ord", F.explode(F.when((F.col("eid") == left) & (F.col("next") == right), F.array("eid", F.lit(new))).otherwise(F.array("eid"))).alias("eid"))
    order = F.when(F.col("eid") == new, 1).otherwise(0)
    numbered = F.row_number().over(Window.partitionBy("path_id").orderBy("ord", order)).cast("long")
    return both.select("path_id", numbered.alias("ord"), "eid")


def merge_pair(paths: DataFrame, left, right) -> DataFrame:
    """``left`` stands for both: ``right`` goes after a ``left`` and becomes one elsewhere."""
    rows = paths.withColumn("prev", F.lag("eid").over(_by())).filter(~((F.col("eid") == right) & (F.coalesce(F.col("prev") == left, F.lit(False)))))
    return rows.select("path_id", F.row_number().over(_by()).cast("long").alias("ord"), F.when(F.col("eid") == right, F.lit(left)).otherwise(F.col("eid")).alias("eid"))


def without_bad(paths: DataFrame, bad: DataFrame) -> DataFrame:
    """Paths that hold no edge of ``bad`` (column eid)."""
    hit = paths.join(bad.select("eid"), "eid", "left_semi").select("path_id").distinct()
    return paths.join(hit, "path_id", "left_anti").select("path_id", "ord", "eid")


def compact(paths: DataFrame, letter: Column | None = None) -> DataFrame:
    """(path_id, start, letters): first edge and one letter for each edge."""
    letter = (lambda x: F.left(x, F.lit(1))) if letter is None else letter
    return as_lists(paths).select("path_id", F.col("eids")[0].alias("start"), F.array_join(F.transform("eids", letter), "").alias("letters"))


def subreads(compacted: DataFrame) -> DataFrame:
    """Paths that are a prefix of another path from the same start (or equal to one): (path_id, supers)."""
    pre = compacted.select("start", F.explode(F.transform(F.sequence(F.lit(1), F.length("letters")), lambda i: F.left("letters", i))).alias("letters"))
    n = pre.groupBy("start", "letters").agg(F.count("*").alias("supers"))
    return compacted.join(n, ["start", "letters"]).filter("supers >= 2").select("path_id", F.col("supers").cast("long").alias("supers"))
