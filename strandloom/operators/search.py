"""Searches along edges (eid, src, dst, len): bounded walks, ways between vertices, tips, cheapest connections.

Each round extends a frontier by one edge in a join and is cut by a written table, so
the driver sees counts only. Bounds (length, steps, results for a pair) are arguments
of the operator, as they are part of what is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans import scratch

MAX_ROUNDS = 10_000


def _step(front: DataFrame, edges: DataFrame) -> DataFrame:
    """Each walk (at, eids, len) longer by one edge."""
    e = edges.select(F.col("src").alias("at"), "eid", "dst", F.col("len").alias("more"))
    return front.join(e, "at").withColumns({"eids": F.concat("eids", F.array("eid")), "len": (F.col("len") + F.col("more")).cast("long"), "at": F.col("dst")}).drop("eid", "dst", "more")


def _start(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.withColumns({"eids": F.array().cast(f"array<{edges.schema['eid'].dataType.simpleString()}>"), "len": F.lit(0).cast("long")})


def all_extensions(edges: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """Every walk of one to ``steps`` edges from the seeds (column vertex): (vertex, eids, len)."""
    front = _start(seeds.select("vertex", F.col("vertex").alias("at")).distinct(), edges)
    found = None
    for _ in range(steps):
        front = scratch.cut(_step(front, edges), "walks")
        found = front if found is None else found.unionByName(front)
    return found.select("vertex", "eids", "len")


def ways(edges: DataFrame, pairs: DataFrame, min_len: int, max_len: int, limit: int = 30) -> DataFrame:
    """Walks from a to b of each pair (pair_id, a, b) with a length in [min_len, max_len]: (pair_id, eids, len).

    At most ``limit`` of a pair, the shortest first. A walk goes on through b; edges
    have a length of one or more, so walks end.
    """
    front = _start(pairs.select("pair_id", "b", F.col("a").alias("at")), edges)
    found = []
    for _ in range(max_len):
        front = scratch.cut(_step(front, edges).filter(F.col("len") <= max_len), "ways")
        if front.isEmpty():
            break
        found.append(front.filter((F.col("at") == F.col("b")) & (F.col("len") >= min_len)).select("pair_id", "eids", "len"))
    if not found:
        return _start(pairs.select("pair_id"), edges).limit(0)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("len", "eids"))
    return every.withColumn("__place", place).filter(F.col("__place") <= limit).drop("__place")


def cheapest(edges: DataFrame, seeds: DataFrame, cost: Column, bound: float | None = None) -> DataFrame:
    """(vertex, cost): the cheapest way to each vertex that the seeds (column vertex) reach, of at most ``bound``; costs are not negative."""
    spark = edges.sparkSession
    e = scratch.cut(edges.select("src", "dst", cost.cast("double").alias("price")).groupBy("src", "dst").agg(F.min("price").alias("price")), "prices")
    known = front = scratch.cut(seeds.select("vertex").distinct().withColumn("cost", F.lit(0.0)), "cheapest")
    path = None
    for _ in range(MAX_ROUNDS):
        step = front.join(e, front["vertex"] == e["src"]).select(F.col("dst").alias("vertex"), (F.col("cost") + F.col("price")).alias("cost"))
        if bound is not None:
            step = step.filter(F.col("cost") <= bound)
        best = step.groupBy("vertex").agg(F.min("cost").alias("cost"))
        front = scratch.cut(best.join(known.withColumnRenamed("cost", "old"), "vertex", "left").filter("old IS NULL OR cost < old - 1e-12").select("vertex", "cost"), "front")
        if front.isEmpty():
            return known
        after, new = scratch.write(known.unionByName(front).groupBy("vertex").agg(F.min("cost").alias("cost")), "cheapest")
        if path:
            scratch.drop(spark, path)
        known, path = after, new
    raise RuntimeError("costs did not settle")


def reachable(edges: DataFrame, seeds: DataFrame, min_cov: int, radius: int) -> DataFrame:
    """(vertex, dist): vertices within ``radius`` of the seeds over edges of coverage ``min_cov`` or more (column cov)."""
    found = cheapest(edges.filter(F.col("cov") >= min_cov), seeds, F.col("len"), radius)
    return found.select("vertex", F.col("cost").cast("long").alias("dist"))


def tip_lengths(edges: DataFrame) -> DataFrame:
    """(eid, tip): edges behind which everything ends, with the longest way to an end.

    An edge into a vertex without a way out is a tip; an edge into a vertex of which
    all ways out are tips is one too. Edges that reach a cycle never are. Rounds are
    as many as the deepest tip has edges.
    """
    e = scratch.cut(edges.select("eid", "src", "dst", F.col("len").cast("long").alias("len")), "tip-edges")
    n_out = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n_out"))
    known = front = scratch.cut(e.join(n_out, e["dst"] == n_out["v"], "left_anti").select("eid", "src", F.col("len").alias("tip")), "tips")
    for _ in range(MAX_ROUNDS):
        near = front.select("src").distinct()  # only vertices that got a tip can have become closed
        closed = known.join(near, "src", "left_semi").groupBy("src").agg(F.count("*").alias("n"), F.max("tip").alias("deep")).join(n_out.withColumnRenamed("v", "src"), "src").filter("n = n_out")
        front = scratch.cut(e.join(closed.select(F.col("src").alias("dst"), "deep"), "dst").join(known.select("eid"), "eid", "left_anti").select("eid", "src", (F.col("len") + F.col("deep")).alias("tip")), "tips")
        if front.isEmpty():
            return known.select("eid", "tip")
        known = scratch.cut(known.unionByName(front), "tips")
    raise RuntimeError("tips did not settle")


def full_extension(unique: DataFrame, max_steps: int = 50) -> DataFrame:
    """(eid, prefix, letters): each stored prefix with all letters that follow as long as the next one is unique.

    ``unique``: (eid, prefix, letter) of ``paths.unique_extension``.
    """
    now = unique.select("eid", "prefix", F.col("letter").alias("letters"), F.concat("prefix", "letter").alias("__at"))
    step = unique.select("eid", F.col("prefix").alias("__at"), "letter")
    for _ in range(max_steps):
        after = scratch.cut(now.join(step, ["eid", "__at"], "left").select("eid", "prefix", F.concat("letters", F.coalesce("letter", F.lit(""))).alias("letters"), F.concat("__at", F.coalesce("letter", F.lit(""))).alias("__at"), F.col("letter").isNotNull().cast("int").alias("moved")), "extensions")
        now = after.drop("moved")
        if not after.agg(F.max("moved")).first()[0]:
            break
    return now.select("eid", "prefix", "letters")


def strand_components(edges: DataFrame, twin: DataFrame) -> DataFrame:
    """One row (components, of_strands, both): components where each strand is a vertex of its own, where strands are one, and those that hold both strands of some vertex.

    ``twin``: (vertex, rc), each vertex' other strand.
    """
    from strandloom.operators.components import connected_components

    apart = scratch.cut(connected_components(edges, a="src", b="dst"), "strands")
    t = twin.select("vertex", "rc")
    tied = connected_components(edges.select("src", "dst").unionByName(t.join(apart.select("vertex"), "vertex", "left_semi").join(apart.select(F.col("vertex").alias("rc")), "rc", "left_semi").select(F.col("vertex").alias("src"), F.col("rc").alias("dst"))), a="src", b="dst")
    own = apart.join(t, "vertex").join(apart.select(F.col("vertex").alias("rc"), F.col("component").alias("other")), "rc").filter("component = other")
    one = apart.agg(F.countDistinct("component").alias("of_strands"))
    two = tied.agg(F.countDistinct("component").alias("components"))
    both = own.agg(F.countDistinct("component").alias("both"))
    return two.crossJoin(one).crossJoin(both)  # one row each
