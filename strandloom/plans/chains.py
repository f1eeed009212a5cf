"""Registered queries: unique edges, chains of bulges, errors beside them, partial matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import matches, packed, unique
from strandloom.plans import scratch
from strandloom.plans.queries import _CONTIGS, _JG, _LINKS, K, _km, contigs, lines, query, table, texts

_BULGED = """n AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS i, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS cov, l_returnflag = 'R' AS twice FROM lineitem),
e AS (SELECT o, i, o || '-' || i AS src, o || '-' || (i + 1) AS dst, o || '-' || i || s AS eid, q + d AS len, cov FROM n, (VALUES ('a', 0), ('b', 5)) v(s, d) WHERE s = 'a' OR twice),
st AS (SELECT o, i, src, dst, count(*) AS n, max(len) AS high, count(*) = 1 OR max(len) < min(len) * 1.3 AS ok FROM e GROUP BY o, i, src, dst),
isl AS (SELECT *, sum(CASE WHEN ok AND before THEN 0 ELSE 1 END) OVER (PARTITION BY o ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce(lag(ok) OVER (PARTITION BY o ORDER BY i), false) AS before FROM st)),
nm AS (SELECT *, count(*) OVER w AS members, min(src || '>' || dst) OVER w AS name FROM isl WINDOW w AS (PARTITION BY o, island)),
ch AS (SELECT e.eid, e.src, e.dst, e.len, e.cov, nm.n, CASE WHEN members > 1 THEN name ELSE 'edge ' || e.eid END AS chain, CASE WHEN members > 1 THEN nm.n ELSE 1 END AS width FROM e JOIN nm USING (src, dst)),
cs AS (SELECT chain, count(*) AS steps, count(*) FILTER (width > 1) AS bulges, sum(high)::BIGINT AS len, coalesce(sum(high) FILTER (width = 1), 0)::BIGINT AS single, coalesce(max(high) FILTER (width > 1), 0)::BIGINT AS widest FROM (SELECT chain, src, dst, any_value(width) AS width, max(len) AS high FROM ch GROUP BY chain, src, dst) GROUP BY chain)"""


def _bulged(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as a row of steps; a returned line has a second edge that is longer by five."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))
    n = table(spark, d, "lineitem").select("l_orderkey", i.alias("i"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("cov"), (F.col("l_returnflag") == "R").alias("twice"))
    sides = F.array_compact(F.array(F.struct(F.lit("a").alias("s"), F.lit(0).alias("d")), F.when(F.col("twice"), F.struct(F.lit("b").alias("s"), F.lit(5).alias("d")))))
    at = F.concat_ws("-", "l_orderkey", "i")
    return n.withColumn("v", F.explode(sides)).select(F.concat(at, "v.s").alias("eid"), at.alias("src"), F.concat_ws("-", "l_orderkey", F.col("i") + 1).alias("dst"), (F.col("q") + F.col("v.d")).alias("len"), "cov")


@query(f"WITH {_BULGED} SELECT chain, steps, bulges, len, single, widest FROM cs")
def bulge_chains(spark, d):
    """Chains of single and double lines of orders, by their steps and lengths."""
    return unique.chain_stats(unique.bulge_chains(_bulged(spark, d)))


@query(f"""WITH {_BULGED} SELECT eid FROM ch JOIN cs USING (chain) WHERE CASE WHEN steps > 1 THEN ch.n > 1 AND widest > 20 AND (single < cs.len // 2 OR steps >= 4) AND cs.len > 100 AND single < cs.len * 95 // 100
 ELSE ch.len > 100 OR ((src NOT IN (SELECT dst FROM e) OR dst NOT IN (SELECT src FROM e)) AND ch.len > 33 AND cov > 4) END""")
def diploid_unique(spark, d):
    """Unique edges of a genome of two copies: sides of bulges in chains longer than a hundred, and long open ends."""
    return unique.diploid_unique(_bulged(spark, d), 100, 20)


_EDGES = "g AS (SELECT l_orderkey || '-' || l_linenumber AS eid, 's' || l_suppkey AS src, 'o' || l_orderkey AS dst, l_quantity::BIGINT AS len FROM lineitem UNION ALL SELECT 'c' || o_orderkey, 'o' || o_orderkey, 'u' || o_custkey, (o_orderkey % 60)::BIGINT FROM orders), uq AS (SELECT eid FROM g WHERE len > 40 OR (len > 13 AND src NOT IN (SELECT dst FROM g)))"


def _supply(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers to orders over the lines, and orders to customers."""
    li = lines(spark, d).select("eid", "src", F.concat(F.lit("o"), F.split("eid", "-")[0]).alias("dst"), "len")
    o = table(spark, d, "orders")
    v = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return li.unionByName(o.select(v("c", "o_orderkey").alias("eid"), v("o", "o_orderkey").alias("src"), v("u", "o_custkey").alias("dst"), (F.col("o_orderkey") % 60).cast("long").alias("len")))


@query(f"WITH {_EDGES} SELECT eid FROM uq")
def long_unique_edges(spark, d):
    return unique.long_unique(_supply(spark, d), 40)


@query(f"""WITH {_EDGES}, m AS (SELECT g.*, CASE WHEN uq.eid IS NULL THEN 0 ELSE 1 END AS u FROM g LEFT JOIN uq USING (eid)),
vx AS (SELECT v, sum(o) AS o, sum(i) AS i, sum(uo) AS uo, sum(ui) AS ui FROM (SELECT src AS v, 1 AS o, 0 AS i, u AS uo, 0 AS ui FROM m UNION ALL SELECT dst, 0, 1, 0, u FROM m) GROUP BY v)
SELECT eid FROM m WHERE u = 0 AND (dst IN (SELECT v FROM vx WHERE o > 0 AND o + 1 = i AND uo = o AND ui = i - 1) OR src IN (SELECT v FROM vx WHERE i > 0 AND i + 1 = o AND ui = i AND uo = o - 1))""")
def error_edges(spark, d):
    """Short lines of orders of which the other line and the way on are unique."""
    e = _supply(spark, d)
    return unique.error_edges(e, unique.long_unique(e, 40))


_PRE = "coalesce(list_max([i FOR i IN range(1, least(length({0}), length({1})) + 1) IF left({0}, i) = left({1}, i)]), 0)::BIGINT"


@query(f"""{_JG}, {_LINKS}, e AS (SELECT DISTINCT src, dst, label FROM links), {_CONTIGS}, {_km('contigs', 'ckm')},
h AS (SELECT read_id, pos, kmer, lead(pos) OVER w AS nxt, lag(pos) OVER w AS prev FROM ckm SEMI JOIN junctions USING (kmer) WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
r AS (SELECT h.*, substr(seq, pos + {K + 1}, coalesce(nxt - pos, length(seq))) AS piece, substr(seq, coalesce(prev, 0) + 1, pos - coalesce(prev, 0)) AS pre FROM h JOIN contigs USING (read_id)),
f AS (SELECT read_id, pos, src, dst, {_PRE.format('label', 'piece')} AS n FROM r JOIN e ON src = kmer AND left(label, 1) = left(piece, 1)),
o AS (SELECT * FROM r ANTI JOIN (SELECT read_id, pos + n AS pos FROM f) x USING (read_id, pos) WHERE pos > 0),
b AS (SELECT read_id, pos, src, dst, length(label) AS size, reverse(left(src || label, length(label))) AS x, reverse(pre) AS y FROM o JOIN e ON dst = kmer AND right(left(src || label, length(label)), 1) = right(pre, 1))
SELECT read_id, pos AS pos_from, pos + n AS pos_to, src, dst, 0::BIGINT AS edge_from, n AS edge_to FROM f WHERE n > 0
UNION ALL SELECT read_id, pos - n, pos, src, dst, size - n, size FROM (SELECT *, {_PRE.format('x', 'y')} AS n FROM b)""")
def partial_matches(spark, d):
    """Stretches of the passages on edges of the documents' graph."""
    r, c = texts(spark, d), contigs(spark, d)
    v = packed.junctions(r, K)
    near = packed.near(c, v)
    return matches.partial_matches(c, v, scratch.cut(packed.edges(r, v, near), "edges"), K)
