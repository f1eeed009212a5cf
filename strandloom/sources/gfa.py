"""GFA 1 (S and L lines), DOT and the graph's other text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq as S


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (name, seq) and links (src, src_sign, dst, dst_sign, overlap)."""
    cells = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("c"))
    s = cells.filter("c[0] = 'S'").select(F.col("c")[1].alias("name"), F.col("c")[2].alias("seq"))
    c = F.col("c")
    links = cells.filter("c[0] = 'L'").select(c[1].alias("src"), c[2].alias("src_sign"), c[3].alias("dst"), c[4].alias("dst_sign"), F.regexp_extract(c[5], r"^(\d+)M", 1).cast("long").alias("overlap"))
    return s, links


def oriented_links(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Links with whether the overlapping letters agree as written, or with the first segment turned: adds ``agrees`` and ``flipped``."""
    one = segments.select(F.col("name").alias("src"), F.col("seq").alias("__a"))
    two = segments.select(F.col("name").alias("dst"), F.col("seq").alias("__b"))
    a = F.when(F.col("src_sign") == "+", F.col("__a")).otherwise(S.rev_comp("__a"))
    b = F.when(F.col("dst_sign") == "+", F.col("__b")).otherwise(S.rev_comp("__b"))
    n = F.col("overlap")
    rows = links.join(one, "src").join(two, "dst").withColumns({"__x": a, "__y": b})
    agrees = F.right("__x", n) == F.left("__y", n)
    return rows.withColumns({"agrees": agrees, "flipped": ~agrees & (F.right(S.rev_comp("__x"), n) == F.left("__y", n))}).drop("__a", "__b", "__x", "__y")


def edge_links(edges: DataFrame) -> DataFrame:
    """Every edge into a vertex with every edge out of it: (src, dst, vertex)."""
    out = edges.select(F.col("src").alias("vertex"), F.col("eid").alias("next"))
    return edges.select(F.col("dst").alias("vertex"), "eid").join(out, "vertex").select(F.col("eid").alias("src"), F.col("next").alias("dst"), "vertex")


def write_gfa(edges: DataFrame, path: str, k: int) -> None:
    """Edges (eid, src, dst, seq whole, cov) as segments with a KC tag, and links of k letters over their vertices."""
    head = edges.sparkSession.createDataFrame([("H\tVN:Z:1.0",)], "value string")
    segs = edges.select(F.concat_ws("\t", F.lit("S"), F.col("eid").cast("string"), "seq", F.concat(F.lit("KC:i:"), F.col("cov").cast("long").cast("string"))).alias("value"))
    links = edge_links(edges).select(F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), F.lit("+"), F.col("dst").cast("string"), F.lit("+"), F.lit(f"{k}M")).alias("value"))
    head.unionByName(segs).unionByName(links).write.text(path)


def write_dot(edges: DataFrame, path: str, colour=None) -> None:
    """Edges (src, dst, seq, cov) as a DOT digraph; labels are first letter, length and coverage."""
    label = F.concat(F.left("seq", F.lit(1)), F.lit(" "), F.length("seq").cast("string"), F.lit("("), F.round("cov", 2).cast("string"), F.lit(")"))
    line = F.concat(F.lit('"'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('" [label="'), label, F.lit('" color="'), F.lit("black") if colour is None else colour, F.lit('"]'))
    body = edges.select(line.alias("value"), F.lit(1).alias("o"), F.xxhash64("src", "dst", "seq").alias("k"))  # the second key spreads the edges over tasks
    ends = edges.sparkSession.createDataFrame([("digraph {\nnodesep = 0.5;", 0), ("}", 2)], "value string, o int").withColumn("k", F.lit(0).cast("long"))
    body.unionByName(ends).orderBy("o", "k").select("value").write.text(path)


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, len, cov) of the edges of a DOT file."""
    pattern = r'"([^"]*)" -> "([^"]*)" \[label="\S+ (\d+)\(([0-9.eE+-]+)\)"'
    rows = spark.read.text(path).filter(F.rlike("value", F.lit(pattern)))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("src"), F.regexp_extract("value", pattern, 2).alias("dst"), F.regexp_extract("value", pattern, 3).cast("long").alias("len"), F.regexp_extract("value", pattern, 4).cast("double").alias("cov"))


def edges_from_strings(strings: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (vertex) and edges (src, dst, seq) of both strands from whole edge strings (column seq)."""
    both = strings.select("seq").unionByName(strings.select(S.rev_comp("seq").alias("seq"))).filter(F.length("seq") > k).distinct()
    edges = both.select(F.left("seq", F.lit(k)).alias("src"), F.right("seq", F.lit(k)).alias("dst"), "seq")
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct(), edges


def write_paths(paths: DataFrame, path: str) -> None:
    """(read_id, start, canonical, letters, lskip, rskip) as text lines; a null start is the empty path."""
    line = F.concat_ws(" ", F.col("read_id").cast("string"), F.coalesce("start", F.lit("0")), F.when(F.col("start").isNull(), "0").otherwise(F.col("canonical").cast("int").cast("string")), F.concat(F.lit("P:"), F.coalesce("letters", F.lit(""))), F.coalesce(F.col("lskip"), F.lit(0)).cast("string"), F.coalesce(F.col("rskip"), F.lit(0)).cast("string"))
    paths.select(line.alias("value")).write.text(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", " ")
    start = F.nullif(c[1], F.lit("0"))
    return spark.read.text(path).select(c[0].alias("read_id"), start.alias("start"), F.when(start.isNotNull(), c[2] == "1").alias("canonical"), F.substr(c[3], F.lit(3)).alias("letters"), c[4].cast("long").alias("lskip"), c[5].cast("long").alias("rskip"))
