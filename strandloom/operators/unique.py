"""Edges that are passed once: long ones, the sides of two-edge bulges in chains, and the errors beside them.

Edges are (eid, src, dst, len[, cov]), each strand a row of its own. All rules look at
an edge's two vertices only, so they are counts by vertex; chains are the components
of steps that share an inner vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components


def long_unique(edges: DataFrame, min_len: int) -> DataFrame:
    """(eid): edges longer than ``min_len``, or than a third of it if nothing leads into their start."""
    entered = edges.select(F.col("dst").alias("src")).distinct().withColumn("__in", F.lit(True))
    return edges.join(entered, "src", "left").filter((F.col("len") > min_len) | (F.col("__in").isNull() & (F.col("len") > min_len // 3))).select("eid")


def error_edges(edges: DataFrame, unique: DataFrame) -> DataFrame:
    """(eid): edges that are not among ``unique`` (column eid), at one end of which all others are and are paired without them."""
    marked = edges.select("eid", "src", "dst").join(unique.select("eid").distinct().withColumn("__u", F.lit(1)), "eid", "left").withColumn("__u", F.coalesce("__u", F.lit(0)))
    side = lambda v, o, i: marked.select(F.col(v).alias("v"), F.lit(o).alias("o"), F.lit(i).alias("i"), (F.col("__u") * o).alias("uo"), (F.col("__u") * i).alias("ui"))
    at = side("src", 1, 0).unionByName(side("dst", 0, 1)).groupBy("v").agg(*[F.sum(c).alias(c) for c in ("o", "i", "uo", "ui")])
    ends = at.filter("o > 0 AND o + 1 = i AND uo = o AND ui = i - 1").select(F.col("v").alias("dst"), F.lit(True).alias("__end"))
    starts = at.filter("i > 0 AND i + 1 = o AND ui = i AND uo = o - 1").select(F.col("v").alias("src"), F.lit(True).alias("__start"))
    return marked.filter("__u = 0").join(ends, "dst", "left").join(starts, "src", "left").filter("__end OR __start").select("eid")


def bulge_chains(edges: DataFrame, ratio: float = 1.3) -> DataFrame:
    """``edges`` with the chain that each belongs to.

    A step is all edges of a pair of vertices. A vertex is inner if one step leads in
    and one out, each of a single edge or of two whose lengths differ by less than
    ``ratio``. Steps that share an inner vertex are a chain, named by its smallest step
    ("src>dst"); every other edge is one of its own ("edge " and its eid).
    """
    step = F.concat_ws(">", "src", "dst")
    steps = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("len").alias("low"), F.max("len").alias("high"))
    steps = steps.select("src", "dst", step.alias("step"), ((F.col("n") == 1) | ((F.col("n") == 2) & (F.col("high") < F.col("low") * ratio))).cast("int").alias("ok"))
    one = lambda v, name: steps.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("k"), F.min("ok").alias("ok"), F.min("step").alias(name)).filter("k = 1 AND ok = 1").select("v", name)
    links = one("dst", "a").join(one("src", "b"), "v").select("a", "b")
    chained = connected_components(links, a="a", b="b").select(F.col("vertex").alias("__step"), F.col("component").alias("chain"))
    return edges.withColumn("__step", step).join(chained, "__step", "left").drop("__step").withColumn("chain", F.coalesce("chain", F.concat(F.lit("edge "), F.col("eid").cast("string"))))


def chain_stats(chains: DataFrame) -> DataFrame:
    """(chain, steps, bulges, len, single, widest): length by the longer side of each step, the part of single edges, the longest side of a bulge."""
    steps = chains.groupBy("chain", "src", "dst").agg(F.count("*").alias("n"), F.max("len").alias("high"))
    wide = F.when(F.col("n") > 1, F.col("high"))
    return steps.groupBy("chain").agg(F.count("*").alias("steps"), F.count(wide).alias("bulges"), F.sum("high").cast("long").alias("len"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("high"))), F.lit(0)).cast("long").alias("single"), F.coalesce(F.max(wide), F.lit(0)).cast("long").alias("widest"))


def diploid_unique(edges: DataFrame, min_len: int, k: int, ratio: float = 1.3) -> DataFrame:
    """(eid): unique edges of a genome of two copies.

    In a chain of two steps or more that is longer than ``min_len``: the sides of its
    bulges, if one is longer than ``k``, single edges make less than half of the chain
    or it has four steps, and they make less than 95 %. Elsewhere: edges longer than
    ``min_len``, or than a third of it at an open end with a coverage above four.
    """
    chains = bulge_chains(edges, ratio)
    stats = chain_stats(chains)
    rich = (F.col("widest") > k) & ((F.col("single") < F.floor(F.col("len") / 2)) | (F.col("steps") >= 4)) & (F.col("len") > min_len) & (F.col("single") < F.floor(F.col("len") * 95 / 100))
    verdict = stats.select("chain", (F.col("steps") > 1).alias("__long"), rich.alias("__rich"))
    sides = edges.groupBy("src", "dst").agg((F.count("*") > 1).alias("__bulge"))
    entered = edges.select(F.col("dst").alias("src")).distinct().withColumn("__in", F.lit(True))
    left = edges.select(F.col("src").alias("dst")).distinct().withColumn("__out", F.lit(True))
    full = chains.join(verdict, "chain").join(sides, ["src", "dst"]).join(entered, "src", "left").join(left, "dst", "left")
    alone = (F.col("len") > min_len) | ((F.col("__in").isNull() | F.col("__out").isNull()) & (F.col("len") > min_len // 3) & (F.col("cov") > 4))
    return full.filter(F.when(F.col("__long"), F.col("__rich") & F.col("__bulge")).otherwise(alone)).select("eid")
