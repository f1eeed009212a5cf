"""Graph operators over (src, dst, ...) edge tables: degrees, statistics, compaction, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import codes as C
from strandloom.functions import seq as S
from strandloom.operators import kmers as KM
from strandloom.operators.components import connected_components
from strandloom.plans import scratch

MAX_ROUNDS = 60


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, in_deg, out_deg) of every vertex that an edge touches."""
    ends = edges.select(F.col("src").alias("vertex"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("vertex"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("vertex").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))


def kind() -> Column:
    """What a vertex is, by its degrees."""
    i, o = F.col("in_deg"), F.col("out_deg")
    return F.when((i == 0) & (o == 0), "isolated").when((i == 0) | (o == 0), "tip").when((i == 1) & (o == 1), "unbranching").otherwise("junction")


def degree_matrix(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("in_deg", "out_deg").agg(F.count("*").alias("vertices"))


def stats(edges: DataFrame, length: str = "len") -> DataFrame:
    """One row: numbers of vertices, edges, tips, junctions, and the total length."""
    v = degrees(edges).agg(F.count("*").alias("vertices"), *[F.sum((kind() == x).cast("long")).alias(x) for x in ("tip", "unbranching", "junction")])
    e = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("total_len"))
    return v.join(e, F.lit(True))  # one row each


def coverage_histogram(edges: DataFrame, cap: int = 200) -> DataFrame:
    return edges.groupBy(F.least(F.floor("cov"), F.lit(cap)).cast("long").alias("cov")).agg(F.count("*").alias("edges"), F.sum("len").cast("long").alias("total_len"))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Pairs of vertices joined by exactly two edges: (src, dst, min_cov, max_cov, len)."""
    both = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("cov").alias("min_cov"), F.max("cov").alias("max_cov"), F.sum("len").alias("total_len"))
    return both.filter("n = 2").drop("n")


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges of which both ends are among ``vertices`` (column vertex)."""
    v = vertices.select("vertex").distinct()
    return edges.join(v.withColumnRenamed("vertex", "src"), "src", "left_semi").join(v.withColumnRenamed("vertex", "dst"), "dst", "left_semi")


def split(edges: DataFrame, cut: Column) -> DataFrame:
    """Components after the edges that satisfy ``cut`` are taken away: (vertex, component)."""
    v = edges.select(F.col("src").alias("vertex")).unionByName(edges.select(F.col("dst").alias("vertex"))).distinct()
    return connected_components(edges.filter(~cut), v, "src", "dst")


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, vertices, edges, tips, total_len)."""
    comp = scratch.cut(connected_components(edges, a="src", b="dst"), "components")
    v = degrees(edges).join(comp, "vertex").groupBy("component").agg(F.count("*").alias("vertices"), F.sum((kind() == "tip").cast("long")).alias("tips"))
    e = edges.join(comp.withColumnRenamed("vertex", "src"), "src").groupBy("component").agg(F.count("*").alias("edges"), F.sum("len").cast("long").alias("total_len"))
    return v.join(e, "component")


def is_acyclic(edges: DataFrame) -> DataFrame:
    """One row (acyclic, left): vertices without a way in, or out, are peeled until none is left to peel."""
    spark = edges.sparkSession
    now, path = scratch.write(edges.select("src", "dst").distinct(), "peel")
    n = now.count()
    while n:
        srcs, dsts = now.select(F.col("src").alias("v")).distinct(), now.select(F.col("dst").alias("v")).distinct()
        after, new = scratch.write(now.join(dsts.withColumnRenamed("v", "src"), "src", "left_semi").join(srcs.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"), "peel")
        m = after.count()
        scratch.drop(spark, path)
        now, path = after, new
        if m == n:
            break
        n = m
    return spark.createDataFrame([(n == 0, n)], "acyclic boolean, left_edges long")


def distances(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(vertex, dist): shortest distances up to ``radius`` from the seeds (column vertex) along the edges and their lengths."""
    spark = edges.sparkSession
    e = edges.select("src", "dst", "len")
    front, fpath = scratch.write(seeds.select("vertex").distinct().withColumn("dist", F.lit(0).cast("long")), "near")
    known = front
    for _ in range(MAX_ROUNDS * 10):
        step = front.join(e, front["vertex"] == e["src"]).select(F.col("dst").alias("vertex"), (F.col("dist") + F.col("len")).cast("long").alias("dist")).filter(F.col("dist") <= radius).groupBy("vertex").agg(F.min("dist").alias("dist"))
        old = known.withColumnRenamed("dist", "old")
        front, fpath = scratch.write(step.join(old, "vertex", "left").filter("old IS NULL OR dist < old").select("vertex", "dist"), "near")
        if front.isEmpty():
            return known
        known = scratch.cut(known.unionByName(front).groupBy("vertex").agg(F.min("dist").alias("dist")), "near")
    raise RuntimeError("distances did not settle")


def unitigs(reads: DataFrame, k: int) -> DataFrame:
    """Maximal unbranching strings of the k-mer graph of both strands, each once for its canonical strand: (unitig, kmers, n).

    ``n`` sums the k-mers' canonical counts. Every k-mer points to its only successor
    if that has no other predecessor; pointers are doubled until none moves on, each
    round a self-join cut by a written table. What still moves lies on cycles, which
    are cut at their smallest canonical k-mer.
    """
    nodes = scratch.cut(KM.nodes(reads, k), "nodes")
    letter = KM.only_letter(4)
    if k <= C.MAX_K:  # drop the first letter, add one
        ahead = C.push_right(F.col("kmer"), letter, k)
    else:
        ahead = F.concat(F.substr("kmer", F.lit(2)), F.substr(F.lit(S.LETTERS), letter + 1, F.lit(1)))
    one_out = nodes.select("kmer", "rc", ahead.alias("next")).filter("next IS NOT NULL")
    one_in = nodes.filter(KM.only_letter(0).isNotNull()).select(F.col("kmer").alias("next"))
    # a hairpin's k-mer never continues into its own reverse complement
    link = scratch.cut(one_out.filter("next <> rc").join(one_in, "next", "left_semi").select("kmer", "next"), "links")
    chains, loops = ranked(nodes.select("kmer"), link)
    if loops is not None:
        chains = chains.unionByName(cut_cycles(loops, link, nodes.select("kmer", F.least("kmer", "rc").alias("canon"))))
    text = chains.join(nodes.select("kmer", "n"), "kmer").groupBy("to").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "kmer"))).alias("path"), F.sum("n").alias("n")
    )
    first = F.col("path")[0]["kmer"]
    if k <= C.MAX_K:
        head, last = C.text(first, k), lambda x: F.substr(F.lit(S.LETTERS), x["kmer"].bitwiseAND(3).cast("int") + 1, F.lit(1))
    else:
        head, last = first, lambda x: F.right(x["kmer"], F.lit(1))
    spelt = F.concat(head, F.array_join(F.transform(F.slice("path", 2, 1 << 30), last), ""))
    both = text.select(spelt.alias("unitig"), F.size("path").cast("long").alias("kmers"), "n")
    return both.filter(S.is_canonical("unitig"))


def ranked(nodes: DataFrame, link: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Nodes (kmer) on chains of links (kmer, next) that end, by their end and the steps to it: (to, kmer, steps); and those on cycles (kmer), if any."""
    spark = nodes.sparkSession
    # rank from the end: jump pointers carry the number of steps
    now, path = scratch.write(nodes.join(link, "kmer", "left").select("kmer", F.coalesce("next", "kmer").alias("to"), F.col("next").isNotNull().cast("long").alias("steps")), "jump")
    moved = None
    open_ends = link.select(F.col("kmer").alias("to"))
    for _ in range(MAX_ROUNDS):
        ahead = now.select(F.col("kmer").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"))
        after, new = scratch.write(now.join(ahead, "to").select("kmer", F.col("to2").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "jump")
        left = after.join(open_ends, "to", "left_semi").count()  # not at an end yet
        scratch.drop(spark, path)
        now, path = after, new
        if left == 0 or left == moved:
            break
        moved = left
    chains = now.join(open_ends, "to", "left_anti").select("to", "kmer", "steps")
    return chains, now.join(open_ends, "to", "left_semi").select("kmer") if left else None


def cut_cycles(loops: DataFrame, link: DataFrame, canon: DataFrame) -> DataFrame:
    """Pure cycles as chains that start at their smallest canonical k-mer (kmer, canon), on the strand that has it: (to, kmer, steps)."""
    inner = link.join(loops, "kmer", "left_semi")
    comp = scratch.cut(connected_components(inner, a="kmer", b="next").select(F.col("vertex").alias("kmer"), "component"), "cycles")
    least = comp.join(canon, "kmer").groupBy("component").agg(F.min(F.struct("canon", "kmer")).alias("m")).filter("m.canon = m.kmer").select("component", F.col("m.kmer").alias("first"))
    one = inner.join(comp, "kmer").join(least, "component")
    now = scratch.cut(one.select("kmer", F.when(F.col("next") != F.col("first"), F.col("next")).alias("next")).select("kmer", F.coalesce("next", "kmer").alias("to"), F.col("next").isNotNull().cast("long").alias("steps")), "cycle-jump")
    for _ in range(MAX_ROUNDS):
        ahead = now.select(F.col("kmer").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"))
        after = scratch.cut(now.join(ahead, "to").select("kmer", F.col("to2").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "cycle-jump")
        if after.agg(F.sum("steps")).first()[0] == now.agg(F.sum("steps")).first()[0]:
            break
        now = after
    return now.select("to", "kmer", "steps")


def collapse_bulges(edges: DataFrame, paths: DataFrame, threshold: float) -> DataFrame:
    """Paths in which the lighter of two parallel edges of little coverage is the heavier one: (path_id, ord, eid)."""
    by = Window.partitionBy("src", "dst")
    ranked = edges.withColumns({"n": F.count("*").over(by), "total": F.sum("cov").over(by), "best": F.first("eid").over(by.orderBy(F.desc("cov"), "eid"))})
    lighter = ranked.filter((F.col("n") == 2) & (F.col("total") < threshold) & (F.col("eid") != F.col("best"))).select("eid", "best")
    return paths.join(lighter, "eid", "left").select("path_id", "ord", F.coalesce("best", "eid").alias("eid"))
