"""The whole pipeline over reads, in phases that restart from their written results.

graph -> threads -> simplify -> resolve -> contigs. Each phase writes Parquet to
``out/<phase>``; a phase whose result is complete is read and not run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import align, graph, variable_k
from strandloom.sources import fastx, gfa

PHASES = ("graph", "threads", "simplified", "rethreaded", "vertices", "edges", "contigs")


def _done(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _phase(spark: SparkSession, out: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    path = f"{out}/{name}"
    if not _done(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def assemble(reads: DataFrame, out: str, k: int = 31, min_cov: float = 2.0, saturating_k: int = 1000, unique_length: int = 10_000, min_contig: int = 0, compress: bool = False) -> DataFrame:
    """Contigs (contig_id, seq) of the reads; all intermediate tables stay under ``out``.

    k is made odd. ``compress``: homopolymer runs become one letter first. Edges of
    ``unique_length`` letters or more count as unique. Only one strand of each contig is
    returned.
    """
    spark, k = reads.sparkSession, k | 1
    seqs = reads.select("read_id", (S.homopolymer_compress("seq") if compress else F.col("seq")).alias("seq"))
    raw = _phase(spark, out, "graph", lambda: align.both_strands(graph.unitigs(seqs, k + 1), k))
    _phase(spark, out, "threads", lambda: align.thread(seqs, raw, k))
    edges = _phase(spark, out, "simplified", lambda: align.simplify(raw, k, min_cov))
    paths = _phase(spark, out, "rethreaded", lambda: align.thread(seqs, edges, k))
    numbered = edges.select("eid", F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), "seq", (F.col("len") >= unique_length).alias("is_unique"))
    both = _with_reverse(paths, edges)
    made: list = []

    def resolved() -> tuple[DataFrame, DataFrame]:
        if not made:
            made.append(variable_k.resolve(numbered, both, k, saturating_k))
        return made[0]

    vertices = _phase(spark, out, "vertices", lambda: resolved()[0])
    final = _phase(spark, out, "edges", lambda: resolved()[1])

    def contigs() -> DataFrame:
        alone = vertices.join(final.select("comp", F.explode(F.array("src", "dst")).alias("id")), ["comp", "id"], "left_anti")
        strings = final.select("seq").unionByName(alone.select("seq"))
        one = strings.select(S.canonical("seq").alias("seq")).distinct().filter(F.length("seq") >= min_contig)
        return one.select(F.xxhash64("seq").alias("contig_id"), "seq")

    return _phase(spark, out, "contigs", contigs)


def _with_reverse(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, ord, eid) of both strands of every piece of a path."""
    name = F.concat_ws("/", F.col("path_id").cast("string"), F.col("piece").cast("string"))
    twin = edges.select("eid", F.xxhash64(S.rev_comp("seq")).alias("twin"))
    fwd = paths.select(F.concat(F.lit("+"), name).alias("path_id"), F.col("ord").cast("int").alias("ord"), "eid")
    rev = paths.join(twin, "eid").select(F.concat(F.lit("-"), name).alias("path_id"), (-F.col("ord")).cast("int").alias("ord"), F.col("twin").alias("eid"))
    return fwd.unionByName(rev)


def write_results(out: str, contigs: DataFrame, k: int) -> None:
    """FASTA of the contigs, GFA and DOT of the simplified graph."""
    spark = contigs.sparkSession
    fastx.write_fasta(contigs, f"{out}/contigs.fa", key="contig_id")
    edges = spark.read.parquet(f"{out}/simplified")
    gfa.write_gfa(edges, f"{out}/graph.gfa", k | 1)
    gfa.write_dot(edges, f"{out}/graph.dot")
