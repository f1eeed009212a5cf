"""Read correction on a graph: reads become edge paths, weak stretches are replaced by supported ones.

Every corrector is a function of a snapshot: paths and edges in, paths out;
coverage is counted again afterwards. Candidates come from joins on the edges'
ends, so a corrector sees only the neighbourhood of the weak edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import kernels as N
from strandloom.functions import seq as S
from strandloom.operators import kmers, paths


def _by():
    return Window.partitionBy("path_id").orderBy("ord")


def coverage(p: DataFrame) -> DataFrame:
    """(eid, cov): how often the paths take each edge."""
    return p.groupBy("eid").agg(F.count("*").alias("cov"))


def precorrect(p: DataFrame, edges: DataFrame, reliable: int, slack: int = 20) -> DataFrame:
    """Steps over an edge of coverage one between reliable neighbours take the only reliable edge of about the same length instead.

    ``edges``: eid, src, dst, len. Coverage is that of the snapshot ``p``.
    """
    cov = edges.join(coverage(p), "eid", "left").withColumn("cov", F.coalesce("cov", F.lit(0)))
    good = cov.filter(F.col("cov") >= reliable)
    weak = cov.filter("cov = 1").select("eid", "src", "dst", F.col("len").alias("weak_len"))
    other = weak.join(good.select("src", "dst", F.col("eid").alias("other"), F.col("len").alias("other_len")), ["src", "dst"]).filter(F.abs(F.col("weak_len") - F.col("other_len")) <= slack)
    only = other.groupBy("eid").agg(F.count("*").alias("n"), F.min("other").alias("other")).filter("n = 1").select("eid", "other")
    near = p.withColumns({"before": F.lag("eid").over(_by()), "after": F.lead("eid").over(_by())})
    ok = good.select(F.col("eid").alias("g"), F.lit(True).alias("ok"))
    marked = near.join(only, "eid", "left").join(ok.withColumnsRenamed({"g": "before", "ok": "ok1"}), "before", "left").join(ok.withColumnsRenamed({"g": "after", "ok": "ok2"}), "after", "left")
    # a step at a path's end has no neighbour to contradict it
    sure = (F.col("ok1") | F.col("before").isNull()) & (F.col("ok2") | F.col("after").isNull())
    return marked.select("path_id", "ord", F.when(sure & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("eid")).alias("eid"))


def trim_tips(p: DataFrame, min_cov: int = 2) -> DataFrame:
    """Paths without the weak edges at their ends; paths with a weak edge inside are dropped."""
    c = p.join(coverage(p), "eid").withColumn("good", F.col("cov") >= min_cov)
    whole = Window.partitionBy("path_id")
    kept = c.withColumns({"first": F.min(F.when(F.col("good"), F.col("ord"))).over(whole), "last": F.max(F.when(F.col("good"), F.col("ord"))).over(whole)}).filter("ord BETWEEN first AND last")
    bad = kept.filter("NOT good").select("path_id").distinct()
    left = kept.join(bad, "path_id", "left_anti")
    return left.select("path_id", F.row_number().over(_by()).cast("long").alias("ord"), "eid")


def low_regions(p: DataFrame, min_cov: int, max_gap: int) -> DataFrame:
    """(path_id, first, last, n): runs of weak steps; runs with at most ``max_gap`` good steps between are one."""
    from strandloom.operators import intervals

    return intervals.islands(p.join(coverage(p), "eid"), "path_id", "ord", F.col("cov") < min_cov, max_gap)


def replace_low(p: DataFrame, edges: DataFrame, min_cov: int, max_steps: int = 4, max_diff: int = 20) -> DataFrame:
    """Weak inner runs of a path take the best supported way of other paths between the same ends.

    Ways are the stretches of up to ``max_steps`` edges that paths take between two edges, all
    of them reliable; a way replaces a run if its length differs by at most ``max_diff``
    and it is the most supported one (ties: the smallest way). One pass; repeat to a
    fix-point by counting changes.
    """
    cov = coverage(p)
    full = p.join(cov, "eid").join(edges.select("eid", "len"), "eid")
    by = _by()
    cols = {f"e{i}": F.lead("eid", i).over(by) for i in range(1, max_steps + 2)} | {f"c{i}": F.lead("cov", i).over(by) for i in range(1, max_steps + 2)} | {f"l{i}": F.lead("len", i).over(by) for i in range(1, max_steps + 2)}
    ahead = full.withColumns(cols)
    ways = None
    for n in range(1, max_steps + 1):
        w = ahead.filter(F.col(f"e{n + 1}").isNotNull()).select(
            "path_id", "ord", F.lit(n).alias("n"), F.col("eid").alias("from"), F.col(f"e{n + 1}").alias("to"), F.array(*[F.col(f"e{i}") for i in range(1, n + 1)]).alias("way"),
            F.least(*[F.col(f"c{i}") for i in range(1, n + 1)], F.lit(1 << 60)).alias("low"), F.greatest(*[F.col(f"c{i}") for i in range(1, n + 1)], F.lit(0)).alias("high"),
            sum((F.col(f"l{i}") for i in range(1, n + 1)), F.lit(0)).alias("size"), F.least("cov", F.col(f"c{n + 1}")).alias("ends"),
        )
        ways = w if ways is None else ways.unionByName(w)
    weak = ways.filter((F.col("high") < min_cov) & (F.col("ends") >= min_cov)).select("path_id", "ord", "n", "from", "to", F.col("size").alias("old_size"))
    known = ways.filter((F.col("low") >= min_cov) & (F.col("ends") >= min_cov)).groupBy("from", "to", "way", "size").agg(F.count("*").alias("support"))
    best = (
        weak.join(known, ["from", "to"])
        .filter(F.abs(F.col("size") - F.col("old_size")) <= max_diff)
        .groupBy("path_id", "ord", "n")
        .agg(F.min(F.struct((-F.col("support")).alias("s"), F.col("way"))).alias("b"))
        .select("path_id", F.col("ord").alias("at"), "n", F.col("b.way").alias("way"))
    )
    lists = paths.as_lists(p)
    edits = best.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("at", "n", "way"))).alias("edits"))
    cut = F.aggregate(
        "edits",
        F.struct(F.lit(0).cast("long").alias("at"), F.slice("eids", 1, 0).alias("out")),
        lambda acc, e: F.when(e["at"] < acc["at"], acc).otherwise(F.struct((e["at"] + e["n"]).cast("long").alias("at"), F.concat(acc["out"], F.slice("eids", (acc["at"] + 1).cast("int"), (e["at"] - acc["at"]).cast("int")), e["way"]).alias("out"))),
        lambda acc: F.concat(acc["out"], F.slice("eids", (acc["at"] + 1).cast("int"), F.greatest(F.size("eids") - acc["at"], F.lit(0)).cast("int"))),
    )
    return paths.as_rows(lists.join(edits, "path_id", "left").select("path_id", F.when(F.col("edits").isNotNull(), cut).otherwise(F.col("eids")).alias("eids")))


def gap_patches(tips: DataFrame, min_overlap: int, max_overlap: int, seed: int, divergence: float) -> DataFrame:
    """Unique overlaps between the open ends of a graph: (t1, t2, suffix, prefix).

    ``tips``: tip_id, seq (read towards the open end). Candidates share a seed k-mer
    with the reverse complement of another tip; an overlap counts if both tips have no
    other. Self-repeating ends propose nothing.
    """
    ends = tips.select("tip_id", F.right("seq", F.lit(max_overlap)).alias("seq"))
    fwd = kmers.kmers(ends.select(F.col("tip_id").alias("read_id"), "seq"), seed).select("read_id", "kmer")
    twice = fwd.groupBy("read_id", "kmer").count().filter("count > 1").select("read_id").distinct()
    fwd = fwd.join(twice, "read_id", "left_anti")
    rev = fwd.select(F.col("read_id").alias("t2"), S.rev_comp("kmer").alias("kmer"))
    pairs = fwd.withColumnRenamed("read_id", "t1").join(rev, "kmer").filter("t1 < t2").select("t1", "t2").distinct()
    a, b = ends.toDF("t1", "a"), ends.toDF("t2", "b")
    o = N.overlap_col(F.col("a"), S.rev_comp("b"), min_overlap, max_overlap, divergence)
    found = pairs.join(a, "t1").join(b, "t2").withColumn("o", o).filter("o.suffix > 0").select("t1", "t2", "o.suffix", "o.prefix")
    deg = found.select(F.explode(F.array("t1", "t2")).alias("t")).groupBy("t").count().filter("count = 1").select("t")
    return found.join(deg.withColumnRenamed("t", "t1"), "t1", "left_semi").join(deg.withColumnRenamed("t", "t2"), "t2", "left_semi").select("t1", "t2", "suffix", "prefix")


def rescue_breaks(edges: DataFrame, ratio: float = 20.0) -> DataFrame:
    """(comp, threshold): components whose sorted coverages jump by ``ratio`` or more; edges below the jump are errors.

    ``edges``: comp, eid, cov. The largest jump counts, the higher one on ties.
    """
    by = Window.partitionBy("comp").orderBy("cov", "eid")
    steps = edges.withColumn("next", F.lead("cov").over(by)).filter(F.col("next") >= F.col("cov") * ratio)
    return steps.groupBy("comp").agg(F.max(F.struct((F.col("next") / F.col("cov")).alias("r"), F.col("next").alias("threshold"))).alias("m")).select("comp", "m.threshold")


def loop_copies(forward: DataFrame, back: DataFrame, medians: DataFrame) -> DataFrame:
    """Extra turns of two-vertex loops: forward edges (src, dst, cov) with back edges (dst to src), votes floor(cov / median + 1/2)."""
    two = forward.select("src", "dst", F.col("cov").alias("fwd")).join(back.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("cov").alias("bck")), ["src", "dst"])
    vote = lambda c: F.floor(F.col(c) / F.col("median") + 0.5).cast("long")
    return two.crossJoin(F.broadcast(medians.agg(F.max("median").alias("median")))).select("src", "dst", vote("fwd").alias("fwd_copies"), vote("bck").alias("back_copies")).withColumn("turns", F.greatest(F.lit(0), F.least(F.col("fwd_copies") - 1, "back_copies")))
