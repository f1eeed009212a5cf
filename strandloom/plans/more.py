"""More registered queries: sources and sinks, searches along edges, checks on edges, paths and contigs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import codes as C
from strandloom.operators import align, checks, correct, kmers, packed, paths, polish, search
from strandloom.plans import scratch
from strandloom.plans.queries import _CONTIGS, _JG, _LINKS, _PATHS, _READS, _SUF, K, W, _km, _rc, contigs, event_paths, query, reads, table, texts
from strandloom.sources import fastx, gfa


def _file(spark: SparkSession, suffix: str) -> str:
    return f"{scratch.root(spark)}/files-{uuid.uuid4().hex}{suffix}"


# --- sources and sinks: written and read back -----------------------------------------------------


@query(f"WITH {_READS} SELECT read_id::VARCHAR AS read_id, 'doc' AS comment, seq FROM reads WHERE length(seq) > 0")
def fasta_files(spark, d):
    """All reads through wrapped FASTA text."""
    path = _file(spark, ".fa")
    named = reads(spark, d).filter(F.length("seq") > 0).withColumn("read_id", F.concat(F.col("read_id").cast("string"), F.lit(" doc")))
    fastx.write_fasta(named, path, 80)
    return fastx.read_fastx(spark, [path])


@query(f"WITH {_READS} SELECT read_id::VARCHAR AS read_id, lower(left(seq, 10)) || substr(seq, 11, greatest(length(seq) - 20, 0)) || CASE WHEN length(seq) > 10 THEN lower(right(seq, least(10, length(seq) - 10))) ELSE '' END AS seq FROM reads")
def masked_ends(spark, d):
    return reads(spark, d).select(F.col("read_id").cast("string").alias("read_id"), fastx.mask_ends("seq", 10, 10).alias("seq"))


_CGRAPH = f"""e AS (SELECT read_id AS eid, left(seq, {K}) AS src, right(seq, {K}) AS dst, seq, (read_id % 7 + 1)::BIGINT AS cov FROM contigs WHERE length(seq) > {K})"""


def _contig_graph(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as edges between their end k-mers."""
    c = contigs(spark, d).filter(F.length("seq") > K)
    return c.select(F.col("read_id").alias("eid"), F.left("seq", F.lit(K)).alias("src"), F.right("seq", F.lit(K)).alias("dst"), "seq", (F.col("read_id") % 7 + 1).cast("long").alias("cov"))


@query(f"WITH {_CONTIGS}, {_CGRAPH} SELECT eid::VARCHAR AS name, seq, NULL::VARCHAR AS dst, NULL::BIGINT AS overlap FROM e UNION ALL SELECT a.eid::VARCHAR, NULL, b.eid::VARCHAR, {K} FROM e a JOIN e b ON a.dst = b.src")
def gfa_files(spark, d):
    """The passages' graph through GFA text: segments, and links over the vertices."""
    path = _file(spark, ".gfa")
    gfa.write_gfa(_contig_graph(spark, d), path, K)
    segments, links = gfa.read_gfa(spark, path)
    return segments.select("name", "seq", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("long").alias("overlap")).unionByName(links.select(F.col("src").alias("name"), F.lit(None).cast("string").alias("seq"), "dst", "overlap"))


@query(f"WITH {_CONTIGS}, {_CGRAPH} SELECT src, dst, length(seq)::BIGINT AS len, cov::DOUBLE AS cov FROM e")
def dot_files(spark, d):
    path = _file(spark, ".dot")
    gfa.write_dot(_contig_graph(spark, d), path)
    return gfa.read_dot(spark, path)


_LINES = "p AS (SELECT l_orderkey AS path_id, l_linenumber::BIGINT AS ord, l_returnflag || l_linestatus AS eid FROM lineitem)"


def _line_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").cast("long").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("eid"))


@query(f"WITH {_PATHS} SELECT path_id::VARCHAR AS read_id, first(eid ORDER BY ord) AS start, true AS canonical, string_agg(left(eid, 1), '' ORDER BY ord) AS letters, path_id % 5 AS lskip, 0::BIGINT AS rskip FROM paths GROUP BY path_id")
def path_files(spark, d):
    """Users' compact paths through alignment text."""
    path = _file(spark, ".aln")
    c = paths.compact(event_paths(spark, d))
    gfa.write_paths(c.select(F.col("path_id").alias("read_id"), "start", F.lit(True).alias("canonical"), "letters", (F.col("path_id") % 5).alias("lskip"), F.lit(0).alias("rskip")), path)
    return gfa.read_paths(spark, path)


@query(f"WITH {_CONTIGS}, {_CGRAPH} SELECT eid, length(seq)::BIGINT AS len, CASE WHEN eid % 2 = 0 THEN cov ELSE 0 END AS cov FROM e")
def coverage_files(spark, d):
    """Coverage of half of the edges, written and read; the others have none."""
    path, e = _file(spark, ".coverage"), _contig_graph(spark, d)
    checks.save_coverage(e.filter("eid % 2 = 0"), path)
    return checks.load_coverage(e, path).select("eid", F.length("seq").cast("long").alias("len"), "cov")


@query(f"WITH {_CONTIGS}, u AS (SELECT seq FROM contigs WHERE length(seq) > {K} UNION SELECT {_rc('seq')} FROM contigs WHERE length(seq) > {K}) SELECT left(seq, {K}) AS src, right(seq, {K}) AS dst, seq FROM u")
def graph_of_strings(spark, d):
    """Both strands' edges from whole strings."""
    return gfa.edges_from_strings(contigs(spark, d), K)[1]


# --- k-mers, vertices, edges ----------------------------------------------------------------------


@query(f"WITH {_CONTIGS}, {_km('contigs')} SELECT read_id, pos, kmer, substr(kmer, 2) || coalesce(nxt, 'A') AS on_right, coalesce(prv, 'T') || left(kmer, {K - 1}) AS on_left FROM km")
def rolled_kmers(spark, d):
    """Each k-mer shifted by the letter after it (A at the end) and by the one before it (T at the start)."""
    by = Window.partitionBy("read_id").orderBy("pos")
    c = kmers.codes(contigs(spark, d), K)
    after, before = F.coalesce(F.lead("code").over(by).bitwiseAND(3), F.lit(0)), F.coalesce(F.shiftright(F.lag("code").over(by), 2 * (K - 1)), F.lit(3))
    return c.select("read_id", "pos", C.text(F.col("code"), K).alias("kmer"), C.text(C.push_right(F.col("code"), after, K), K).alias("on_right"), C.text(C.push_left(F.col("code"), before, K), K).alias("on_left"))


@query(f"WITH {_READS}, {_km('reads')}, mm AS (SELECT read_id, pos, min(canon) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS m, len FROM km) SELECT m AS kmer FROM mm WHERE len >= {K + W - 1} AND pos <= len - {K - 1} - {W} UNION SELECT canon FROM km WHERE len >= {K} AND (pos = 0 OR pos = len - {K})")
def tied_vertices(spark, d):
    """Minimizers with the k-mers at the reads' ends: open ends become vertices."""
    return kmers.tie_ends(reads(spark, d), kmers.minimizer_codes(reads(spark, d), K, W).select("code"), K).select(C.text(F.col("code"), K).alias("kmer"))


@query(f"{_JG}, {_LINKS.replace('FROM km SEMI JOIN', 'FROM ckm SEMI JOIN').replace('JOIN reads r', 'JOIN contigs r').replace('steps AS', _CONTIGS + ', ' + _km('contigs', 'ckm') + ', steps AS', 1)} SELECT read_id, pos, src, dst, label FROM links")
def recut_contigs(spark, d):
    """Passages cut at the junctions of the documents."""
    return kmers.links(contigs(spark, d), kmers.junction_codes(reads(spark, d), K), K)


@query(f"{_JG}, {_LINKS}, e AS (SELECT DISTINCT src, label FROM links), o AS (SELECT src, label, row_number() OVER w AS place, lag(label) OVER w AS b FROM e WINDOW w AS (PARTITION BY src ORDER BY label)) SELECT src, label, place, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_max([i FOR i IN range(1, least(length(b), length(label)) + 1) IF left(b, i) = left(label, i)]), 0) END::BIGINT AS common FROM o")
def sorted_out_edges(spark, d):
    r = texts(spark, d)
    return packed.sorted_out_edges(r, packed.junctions(r, K))


_HEADS = "h AS (SELECT DISTINCT left(seq, 3) AS src, substr(seq, 4, 1 + read_id % 8) AS label FROM reads WHERE length(seq) > 12)"


@query(f"WITH {_READS}, {_HEADS} SELECT src, label FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.src = h.src AND o.label <> h.label AND starts_with(o.label, h.label))")
def merged_prefixes(spark, d):
    """Labels of a vertex (a read's first three letters) of which none begins another."""
    h = reads(spark, d).filter(F.length("seq") > 12).select(F.left("seq", F.lit(3)).alias("src"), F.substr("seq", F.lit(4), (1 + F.col("read_id") % 8).cast("int")).alias("label"))
    return checks.merge_prefixes(h)


@query(f"""{_JG}, {_LINKS}, e AS (SELECT DISTINCT src, dst, label, src || label AS whole FROM links)
SELECT 'end' AS "check", count(*) AS n FROM e WHERE right(label, least(length(dst), length(label))) <> right(dst, least(length(dst), length(label)))
UNION ALL SELECT 'letter', coalesce(sum(m) FILTER (m > 1), 0)::BIGINT FROM (SELECT count(*) AS m FROM e GROUP BY src, left(label, 1))
UNION ALL SELECT 'twin', count(*) FROM e WHERE {_rc('whole')} NOT IN (SELECT whole FROM e)""")
def graph_violations(spark, d):
    """Rules of the documents' k-mer graph and how many edges break them."""
    r = texts(spark, d)
    return packed.violations(r, packed.junctions(r, K))


@query(f"WITH {_CONTIGS}, s AS (SELECT read_id, seq, unnest(range(0, length(seq) - 40, 25)) AS l FROM contigs), c AS (SELECT substr(seq, l + 1, 40) AS seq FROM s), u AS (SELECT seq FROM c UNION SELECT {_rc('seq')} FROM c) SELECT left(seq, {K}) AS src, right(seq, {K}) AS dst, seq FROM u")
def segment_subgraph(spark, d):
    """Both strands' edges of overlapping windows of the passages."""
    c = contigs(spark, d)
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 41, F.lit(0)), F.lit(25))
    s = c.filter(F.length("seq") > 40).select("read_id", F.explode(starts).alias("left")).withColumn("right", F.col("left") + 40)
    return checks.subgraph_edges(c, s, K)


@query(f"WITH {_READS}, s AS (SELECT read_id, seq FROM reads WHERE length(seq) >= 6), a AS (SELECT right(seq, 6) AS mer, min(read_id) AS l FROM s GROUP BY 1 HAVING count(*) = 1), b AS (SELECT left(seq, 6) AS mer, min(read_id) AS r FROM s GROUP BY 1 HAVING count(*) = 1) SELECT l AS \"left\", r AS \"right\" FROM a JOIN b USING (mer)")
def contig_links(spark, d):
    """Reads linked end to start by six letters that end one read only and start one only."""
    return checks.unique_links(reads(spark, d), 6)


@query(f"WITH {_READS} SELECT read_id, length(seq)::BIGINT AS size, row_number() OVER (ORDER BY length(seq) DESC, seq, read_id) AS place FROM reads")
def ranked_reads(spark, d):
    """Reads by length, longest first."""
    return checks.rank_by_length(reads(spark, d))


@query(f"WITH {_READS} SELECT read_id, 'whole' AS part, seq FROM reads WHERE length(seq) <= 2000 UNION ALL SELECT read_id, 'start', left(seq, 500) FROM reads WHERE length(seq) > 2000 UNION ALL SELECT read_id, 'end', right(seq, 500) FROM reads WHERE length(seq) > 2000")
def long_read_ends(spark, d):
    return checks.ends_of_long(reads(spark, d), 2000, 500)


_CANDS = """b AS (SELECT item_id AS group_id, left(text, 40) AS target FROM benchmark), c AS (SELECT group_id, 1 AS cand_id, target, translate(target, 'e', 'o') AS seq FROM b UNION ALL SELECT group_id, 2, target, translate(target, 'ea', 'ou') FROM b UNION ALL SELECT group_id, 3, target, translate(target, 'i', 'y') FROM b WHERE group_id % 2 = 1),
q AS (SELECT *, levenshtein(target, seq) AS dist, greatest(20, floor(length(target) / 100)) AS allowed FROM c), w AS (SELECT group_id, arg_min(cand_id, (dist, cand_id)) AS winner, arg_min(seq, (dist, cand_id)) AS wseq, min(dist) AS wdist FROM q GROUP BY group_id)"""


@query(f"WITH {_CANDS} SELECT q.group_id, w.winner, any_value(w.wdist)::BIGINT AS dist FROM q JOIN w USING (group_id) GROUP BY q.group_id, w.winner HAVING any_value(w.wdist) <= max(q.allowed) AND count(*) FILTER (q.cand_id <> w.winner AND q.dist < q.allowed AND q.dist <> w.wdist + levenshtein(w.wseq, q.seq)) = 0")
def nearest_candidate(spark, d):
    """Changed copies of each passage's start: the nearest, unless another near one is changed elsewhere."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("group_id"), F.left("text", F.lit(40)).alias("target"))
    made = [(1, "e", "o", F.lit(True)), (2, "ea", "ou", F.lit(True)), (3, "i", "y", F.col("group_id") % 2 == 1)]
    cands = F.array_compact(F.array(*[F.when(use, F.struct(F.lit(i).alias("cand_id"), F.translate("target", x, y).alias("seq"))) for i, x, y, use in made]))
    return checks.tournament(b.select("group_id", "target", F.explode(cands).alias("c")).select("group_id", "target", "c.cand_id", "c.seq"))


# --- searches along edges -------------------------------------------------------------------------

_STEPS = f"{_PATHS}, tr AS (SELECT e1, e2, count(*) AS n FROM (SELECT eid AS e1, lead(eid) OVER (PARTITION BY path_id ORDER BY ord) AS e2 FROM paths) WHERE e2 IS NOT NULL GROUP BY ALL), g AS (SELECT e1 || '>' || e2 AS eid, e1 AS src, e2 AS dst, 1 + (n % 3)::BIGINT AS len, n AS cov FROM tr)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """The event types' graph of transitions."""
    t = paths.transitions(event_paths(spark, d))
    return t.select(F.concat_ws(">", "e1", "e2").alias("eid"), F.col("e1").alias("src"), F.col("e2").alias("dst"), (1 + F.col("n") % 3).cast("long").alias("len"), F.col("n").alias("cov"))


@query(f"WITH RECURSIVE {_STEPS}, walk AS (SELECT src AS vertex, dst AS here, eid AS eids, len, 1 AS steps FROM g UNION ALL SELECT vertex, g.dst, eids || ' ' || g.eid, walk.len + g.len, steps + 1 FROM walk JOIN g ON g.src = walk.here WHERE steps < 3) SELECT vertex, eids, len FROM walk")
def all_extensions(spark, d):
    """Every walk of up to three transitions from every event type."""
    e = _steps(spark, d)
    return search.all_extensions(e, e.select(F.col("src").alias("vertex")), 3).select("vertex", F.array_join("eids", " ").alias("eids"), "len")


@query(f"WITH RECURSIVE {_STEPS}, pr AS (SELECT a.src || '-' || b.src AS pair_id, a.src AS a, b.src AS b FROM (SELECT DISTINCT src FROM g) a, (SELECT DISTINCT src FROM g) b WHERE a.src < b.src), walk AS (SELECT pair_id, b, g.dst AS here, [g.eid] AS eids, g.len FROM pr JOIN g ON g.src = a WHERE g.len <= 6 UNION ALL SELECT pair_id, b, g.dst, list_append(eids, g.eid), walk.len + g.len FROM walk JOIN g ON g.src = walk.here WHERE walk.len + g.len <= 6), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY len, eids) AS k FROM walk WHERE here = b AND len >= 3) SELECT pair_id, array_to_string(eids, ' ') AS eids, len FROM r WHERE k <= 30")
def ways_between(spark, d):
    """Ways of a length from three to six between event types, the thirty shortest of each pair."""
    e = _steps(spark, d)
    v = e.select("src").distinct()
    pairs = v.select(F.col("src").alias("a")).join(v.select(F.col("src").alias("b")), F.col("a") < F.col("b")).withColumn("pair_id", F.concat_ws("-", "a", "b"))
    return search.ways(e, pairs, 3, 6).select("pair_id", F.array_join("eids", " ").alias("eids"), "len")


@query(f"WITH RECURSIVE {_STEPS}, pr AS (SELECT src, dst, min(len / greatest(least(cov, 40), 1)::DOUBLE) AS price FROM g GROUP BY ALL), walk AS (SELECT src AS here, 0::DOUBLE AS cost, 0 AS k FROM (SELECT min(src) AS src FROM g) UNION SELECT pr.dst, cost + price, k + 1 FROM walk JOIN pr ON pr.src = walk.here WHERE k < 6) SELECT here AS vertex, round(min(cost), 9) AS cost FROM walk GROUP BY here")
def cheapest_connections(spark, d):
    """Cheapest ways from the first event type: a transition costs its length over its coverage, of which 40 counts at most."""
    e = _steps(spark, d)
    seed = e.agg(F.min("src").alias("vertex"))
    return search.cheapest(e, seed, F.col("len") / F.greatest(F.least("cov", F.lit(40)), F.lit(1))).select("vertex", F.round("cost", 9).alias("cost"))


@query(f"WITH RECURSIVE {_STEPS}, ok AS (SELECT * FROM g WHERE cov >= (SELECT median(cov) FROM g)), walk AS (SELECT src AS here, 0::BIGINT AS dist FROM (SELECT min(src) AS src FROM g) UNION SELECT ok.dst, dist + len FROM walk JOIN ok ON ok.src = walk.here WHERE dist + len <= 5) SELECT here AS vertex, min(dist) AS dist FROM walk GROUP BY here")
def reachable_reliably(spark, d):
    """Event types within five of the first one over transitions of median coverage or more."""
    e = _steps(spark, d)
    low = int(-(-e.agg(F.median("cov")).first()[0] // 1))
    return search.reachable(e, e.agg(F.min("src").alias("vertex")), low, 5)


_TREE = "g AS (SELECT 'n' || n_nationkey AS eid, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, (n_nationkey + 1)::BIGINT AS len FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'c' || c_custkey, (c_custkey % 7 + 1)::BIGINT FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'o' || o_orderkey, (o_orderkey % 5 + 1)::BIGINT FROM orders UNION ALL SELECT 'back', 'n3', 'r1', 1)"


@query(f"""WITH {_TREE}, o AS (SELECT eid, src, len AS tip FROM g WHERE eid[1] = 'o'), c AS (SELECT g.eid, any_value(g.src) AS src, any_value(g.len) + coalesce(max(o.tip), 0) AS tip FROM g LEFT JOIN o ON o.src = g.dst WHERE g.eid[1] = 'c' GROUP BY g.eid),
n AS (SELECT g.eid, any_value(g.len) + coalesce(max(c.tip), 0) AS tip FROM g LEFT JOIN c ON c.src = g.dst WHERE g.eid[1] = 'n' AND g.eid <> 'n3' AND g.src <> 'none' GROUP BY g.eid)
SELECT eid, tip FROM o UNION ALL SELECT eid, tip FROM c UNION ALL SELECT eid, tip FROM n""")
def tip_lengths(spark, d):
    """Longest ways to an end over regions, nations, customers and orders; a way back from nation 3 to its region leaves what leads to it open."""
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    v = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    edge = lambda df, a, ka, b, kb, size: df.select(v(b, kb).alias("eid"), v(a, ka).alias("src"), v(b, kb).alias("dst"), size.cast("long").alias("len"))
    e = edge(n, "r", "n_regionkey", "n", "n_nationkey", F.col("n_nationkey") + 1).unionByName(edge(c, "n", "c_nationkey", "c", "c_custkey", F.col("c_custkey") % 7 + 1)).unionByName(edge(o, "c", "o_custkey", "o", "o_orderkey", F.col("o_orderkey") % 5 + 1))
    back = n.filter("n_nationkey = 3").select(F.lit("back").alias("eid"), F.lit("n3").alias("src"), v("r", "n_regionkey").alias("dst"), F.lit(1).cast("long").alias("len"))
    return search.tip_lengths(e.unionByName(back))


@query(f"{_SUF.replace('WITH', 'WITH RECURSIVE', 1)}, st AS (SELECT eid, left(prefix, length(prefix) - 1) AS prefix, right(prefix, 1) AS letter, n FROM sup WHERE length(prefix) > 1), u AS (SELECT eid, prefix, arg_max(letter, (n, letter)) AS letter FROM st GROUP BY eid, prefix HAVING count(*) FILTER (n >= 3) = 1 AND count(*) FILTER (n > 1) = 1), x AS (SELECT eid, prefix, letter AS letters FROM u UNION ALL SELECT x.eid, x.prefix, x.letters || u.letter FROM x JOIN u ON u.eid = x.eid AND u.prefix = x.prefix || x.letters) SELECT eid, prefix, arg_max(letters, length(letters)) AS letters FROM x GROUP BY eid, prefix")
def full_extensions(spark, d):
    """All letters that follow a stored prefix as long as the next one is the only supported one."""
    return search.full_extension(paths.unique_extension(paths.prefix_support(paths.suffixes(event_paths(spark, d), 5), 5), 3, 1))


# --- paths ----------------------------------------------------------------------------------------


@query(f"WITH {_LINES}, b AS (SELECT path_id FROM p GROUP BY path_id HAVING count(*) > 1) SELECT DISTINCT eid || '-' || (path_id % 200) AS eid FROM p EXCEPT SELECT eid || '-' || (path_id % 200) FROM p SEMI JOIN b USING (path_id)")
def lonely_edges(spark, d):
    """Line states (by order number modulo 200) that only orders of one line hold."""
    p = _line_paths(spark, d).withColumn("eid", F.concat_ws("-", "eid", (F.col("path_id") % 200).cast("string")))
    return checks.lonely_edges(p)


@query(f"WITH {_LINES}, s AS (SELECT path_id, min(ord) FILTER (eid <> 'NF') AS a, max(ord) FILTER (eid <> 'NF') AS b FROM p GROUP BY path_id), i AS (SELECT p.* FROM p JOIN s USING (path_id) WHERE ord BETWEEN a AND b) SELECT path_id, ord, eid FROM i WHERE path_id NOT IN (SELECT path_id FROM i WHERE eid = 'NF')")
def trimmed_paths(spark, d):
    """Orders without lines of one state at their ends; those with such a line inside go."""
    return checks.trim_ends(_line_paths(spark, d), spark.createDataFrame([("NF",)], "eid string"))


@query(f"WITH {_LINES}, q AS (SELECT conv_id AS path_id, turn::BIGINT AS ord, role AS eid FROM conversations) SELECT path_id, ord, p.eid AS first, q.eid AS second FROM p JOIN q USING (path_id, ord)")
def zipped_paths(spark, d):
    """Orders' lines beside the turns of the conversation of the same number."""
    q = table(spark, d, "conversations").select(F.col("conv_id").alias("path_id"), F.col("turn").cast("long").alias("ord"), F.col("role").alias("eid"))
    return checks.zipped(_line_paths(spark, d), q)


@query(f"WITH {_PATHS}, b AS (SELECT path_id, string_agg(left(eid, 1), '' ORDER BY ord) AS was FROM paths GROUP BY path_id), a AS (SELECT path_id, string_agg(left(eid, 1), '' ORDER BY ord) AS now FROM paths WHERE eid <> 'click' AND path_id % 10 <> 0 GROUP BY path_id) SELECT path_id, was, now, CASE WHEN now IS NULL THEN 'invalidated' WHEN now <> was THEN 'rerouted' ELSE 'initial' END AS state FROM b LEFT JOIN a USING (path_id)")
def read_audit(spark, d):
    """Users' paths before and after clicks and every tenth path are taken out."""
    p = event_paths(spark, d)
    return checks.audit(p, paths.remove_edge(p.filter("path_id % 10 <> 0"), "click"))


@query("WITH s AS (SELECT l_suppkey AS sup, l_partkey AS l, (l_partkey + l_quantity)::BIGINT AS r FROM lineitem), o AS (SELECT *, lead(l) OVER (PARTITION BY sup ORDER BY l, r) AS nxt FROM s) SELECT sup, count(*) AS pieces, count(*) FILTER (nxt <> r) AS breaks FROM o GROUP BY sup")
def alignment_breaks(spark, d):
    """Consecutive stretches of each supplier that do not go on where the last one ended."""
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sup"), F.col("l_partkey").alias("left"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("right"))
    return checks.breaks(s, "sup")


# --- polishing and correction operators -----------------------------------------------------------


@query("WITH v AS (SELECT l_partkey AS contig_id, l_suppkey AS pos, l_quantity::BIGINT AS run, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_quantity) AS k FROM lineitem), c AS (SELECT contig_id, pos, list_sort(list(run)) AS x, count(*) AS n FROM v WHERE k <= 21 GROUP BY ALL) SELECT contig_id, pos, n, x[(1 + n) // 2] AS run FROM c")
def median_runs(spark, d):
    """Run length votes (quantities of a part from a supplier) and their median slot."""
    v = table(spark, d, "lineitem").select(F.col("l_partkey").alias("contig_id"), F.col("l_suppkey").alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.col("l_quantity").cast("long").alias("run"))
    return polish.median_runs(v)


@query("SELECT c.item_id AS contig_id, string_agg(repeat(substr(c.s, i, 1), CASE WHEN i % 4 = 0 THEN 1 + (i % 3)::INT ELSE 1 END), '' ORDER BY i) AS seq FROM (SELECT item_id, s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM benchmark)) c GROUP BY c.item_id")
def written_runs(spark, d):
    """Passages with the runs of every fourth place written out, once where nothing is known."""
    c = contigs(spark, d).withColumnRenamed("read_id", "contig_id").filter(F.length("seq") > 0)
    runs = c.select("contig_id", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos")).filter((F.col("pos") + 1) % 4 == 0).withColumn("run", 1 + (F.col("pos") + 1) % 3)
    return polish.uncompress(c, runs)


@query("WITH e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, sum(l_quantity)::DOUBLE AS cov FROM lineitem GROUP BY ALL), m AS (SELECT median(cov) AS median FROM e), t AS (SELECT a AS src, b AS dst, floor(cov / median + 0.5)::BIGINT AS fwd_copies, floor((cov + length(a)) / median + 0.5)::BIGINT AS back_copies FROM e, m) SELECT src, dst, fwd_copies, back_copies, greatest(0, least(fwd_copies - 1, back_copies)) AS turns FROM t")
def loop_turns(spark, d):
    """Turns of the loops that suppliers and parts form if every trade also goes back with a little more coverage."""
    e = table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.sum("l_quantity").cast("double").alias("cov"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("cov") + F.length("src")).alias("cov"))
    return correct.loop_copies(e, back, e.agg(F.median("cov").alias("median")))


@query(f"WITH {_CONTIGS}, u AS (SELECT seq, 1 AS n FROM contigs WHERE length(seq) > {K + 1}), b AS (SELECT seq FROM u UNION SELECT {_rc('seq')} FROM u) SELECT left(seq, {K}) AS src, right(seq, {K}) AS dst, seq, (length(seq) - {K})::BIGINT AS len FROM b")
def edges_of_both_strands(spark, d):
    """Passages as unitigs: edges of both strands."""
    u = contigs(spark, d).filter(F.length("seq") > K + 1).select(F.col("seq").alias("unitig"), (F.length("seq") - K).alias("kmers"), F.lit(1).alias("n"))
    return align.both_strands(u, K).select("src", "dst", "seq", "len")
