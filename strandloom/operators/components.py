"""Connected components of an edge table by large-star / small-star rounds.

Each round rewires every edge to the smallest neighbour seen from its ends; the
edge table never grows and the number of rounds grows with the logarithm of the
longest path. Minima are plain aggregations (partial sums before the shuffle), so
a vertex with very many edges is no hot spot, and each round is cut by a written
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans import scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One rewiring: neighbours of ``u`` that are larger (or not larger) go to u's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def _open_vertices(edges: DataFrame) -> int:
    """Vertices that keep the edges from being stars: with two centres, or both centre and ray."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("ray"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("ray"), F.lit(1).alias("centre")))
    found = ends.groupBy("v").agg(F.sum("ray").alias("rays"), F.max("centre").alias("centre")).filter("rays > 1 OR rays = 1 AND centre = 1")
    return found.count()


def star_rounds(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) for each vertex but the smallest of its component: ``b`` is that smallest one."""
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    now, path = scratch.write(pairs, "edges")
    for _ in range(MAX_ROUNDS):
        if not _open_vertices(now):
            return now
        after, new = scratch.write(_star(_star(now, True), False), "edges")
        scratch.drop(spark, path)
        now, path = after, new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) with the component's smallest vertex; isolated vertices from ``vertices`` (column ``vertex``)."""
    ends = edges.select(F.col(a).alias("vertex")).unionByName(edges.select(F.col(b).alias("vertex"))).filter("vertex IS NOT NULL")
    if vertices is not None:
        ends = ends.unionByName(vertices.select("vertex"))
    stars = star_rounds(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    return ends.distinct().join(stars.select(F.col("a").alias("vertex"), F.col("b").alias("component")), "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
