"""Registered queries of the sequence-graph operators over the test tables, with DuckDB SQL of the same rows.

Every query reads its whole tables. Documents become reads over ACGT, users'
events become paths, order lines become a graph of suppliers and parts, and
benchmark passages become contigs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import codes as C
from strandloom.functions import segments as G
from strandloom.functions import seq as S
from strandloom.operators import compact, graph, intervals, kmers, packed, paths

K, W = 15, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    return kmers.letter_reads(table(spark, d, "documents"))


def texts(spark: SparkSession, d: str) -> packed.Texts:
    """``reads`` for packed operators."""
    return kmers.letter_texts(table(spark, d, "documents"))


def contigs(spark: SparkSession, d: str) -> DataFrame:
    return kmers.letter_reads(table(spark, d, "benchmark"), "item_id")


def event_paths(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("path_id"), F.row_number().over(by).cast("long").alias("ord"), F.col("event_type").alias("eid"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Edges supplier -> part: len is the quantity, cov the number of order lines."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("len"), F.count("*").alias("cov"))
    return g.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "len", "cov")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as parallel edges supplier -> part with ids: len is the quantity, cov the line number."""
    li = table(spark, d, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("eid"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("len"), F.col("l_linenumber").cast("long").alias("cov"))


def stretches(spark: SparkSession, d: str) -> DataFrame:
    """Segments on suppliers: [part, part + quantity)."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sup"), F.col("l_partkey").alias("left"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("right"))


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


_READS = "reads AS (SELECT doc_id AS read_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"
_CONTIGS = "contigs AS (SELECT item_id AS read_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark)"


def _km(of: str, name: str = "km", k: int = K) -> str:
    """k-mers of ``of`` with their neighbour letters; reads are cut into parts first, as a substring's cost grows with its place."""
    parts = f"SELECT read_id, length(seq) AS len, o, substr('$' || seq || '$', o + 1, {256 + k + 1}) AS part FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {k - 1}, 256)) AS o FROM {of} WHERE length(seq) >= {k})"
    cut = f"SELECT read_id, len, (o + j)::BIGINT AS pos, substr(part, j + 2, {k}) AS kmer, nullif(substr(part, j + 1, 1), '$') AS prv, nullif(substr(part, j + {k + 2}, 1), '$') AS nxt FROM (SELECT *, unnest(range(0, least(256, len - {k - 1} - o))) AS j FROM ({parts}))"
    return f"{name} AS (SELECT *, least(kmer, {_rc('kmer')}) AS canon FROM ({cut}))"


_JUNCTIONS = f"""both_ AS (SELECT kmer, prv, nxt FROM km UNION ALL SELECT {_rc('kmer')}, translate(nxt, 'ACGT', 'TGCA'), translate(prv, 'ACGT', 'TGCA') FROM km),
junctions AS (SELECT kmer, count(DISTINCT prv) AS in_deg, count(DISTINCT nxt) AS out_deg FROM both_ GROUP BY kmer HAVING count(DISTINCT prv) <> 1 OR count(DISTINCT nxt) <> 1)"""
_LINKS = f"""steps AS (SELECT read_id, pos, kmer AS src, lead(kmer) OVER w AS dst, lead(pos) OVER w - pos AS d FROM km SEMI JOIN junctions USING (kmer) WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
links AS (SELECT read_id, pos, src, dst, right(dst, d) AS label FROM steps WHERE d <= {K} UNION ALL
  SELECT s.read_id, pos, src, dst, substr(seq, pos + {K + 1}, d) FROM steps s JOIN reads r ON r.read_id = s.read_id WHERE d > {K})"""
_JG = f"WITH {_READS}, {_km('reads')}, {_JUNCTIONS}"
_PATHS = "paths AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS eid FROM events)"
_TRADE = "trade AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_quantity)::BIGINT AS len, count(*) AS cov FROM lineitem GROUP BY ALL)"
_DEG = "deg AS (SELECT vertex, sum(i)::BIGINT AS in_deg, sum(o)::BIGINT AS out_deg FROM (SELECT src AS vertex, 0 AS i, 1 AS o FROM {0} UNION ALL SELECT dst, 1, 0 FROM {0}) GROUP BY vertex)"
_STRETCH = "seg AS (SELECT l_suppkey AS sup, l_partkey AS l, (l_partkey + l_quantity)::BIGINT AS r FROM lineitem)"
_UNION = """seg_u AS (SELECT sup, min(l) AS l, max(r) AS r, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY sup ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS id FROM
  (SELECT *, CASE WHEN max(r) OVER (PARTITION BY sup ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= l THEN 0 ELSE 1 END AS new FROM seg)) GROUP BY sup, id)"""


# --- sequences -----------------------------------------------------------------------------------


@query(f"WITH {_READS}, {_km('reads')} SELECT canon, count(*) AS n FROM km GROUP BY canon")
def kmer_counts(spark, d):
    return kmers.counts(reads(spark, d), K)


@query(f"WITH {_READS}, {_km('reads')} SELECT least(n, 200)::BIGINT AS n, count(*) AS kmers FROM (SELECT count(*) AS n FROM km GROUP BY canon) GROUP BY 1")
def kmer_spectrum(spark, d):
    return kmers.spectrum(reads(spark, d), K)


@query(f"WITH {_READS} SELECT read_id, pos::BIGINT AS pos, substr(seq, pos + 1, 1000) AS chunk FROM (SELECT read_id, seq, unnest(range(0, greatest(length(seq) - 100, 1), 900)) AS pos FROM reads WHERE length(seq) > 0)")
def read_chunks(spark, d):
    return kmers.chunks(reads(spark, d), 1000, 100)


@query("SELECT doc_id, regexp_full_match(text, '[ACGTNacgtn]*') AS valid, translate(text, 'abcdefghijklmnopqrstuvwxyzN', 'ABCDEFGHIJKLMAOPQRSTUVWXYZA') AS letters FROM documents")
def nucleotide_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", S.is_nucleotides("text").alias("valid"), S.nucleotides("text").alias("letters"))


@query("SELECT doc_id, split_part(text, ' ', 1) AS id, CASE WHEN instr(text, ' ') > 0 THEN substr(text, instr(text, ' ') + 1) ELSE '' END AS comment FROM documents")
def record_headers(spark, d):
    return table(spark, d, "documents").select("doc_id", S.record_id("text").alias("id"), S.record_comment("text").alias("comment"))


@query(f"WITH {_READS} SELECT read_id, {_rc('seq')} AS rc, seq <= {_rc('seq')} AS canonical FROM reads")
def rev_comp(spark, d):
    return reads(spark, d).select("read_id", S.rev_comp("seq").alias("rc"), S.is_canonical("seq").alias("canonical"))


@query(f"WITH {_READS} SELECT read_id, left(seq, 20) AS head, right(seq, 20) AS tail, substr(seq, 11, 10) AS inner_part, left(seq, 5) || repeat('AC', 3) || right(seq, 5) AS built FROM reads")
def affixes(spark, d):
    return reads(spark, d).select("read_id", S.prefix("seq", 20).alias("head"), S.suffix("seq", 20).alias("tail"), F.substring("seq", 11, 10).alias("inner_part"), F.concat(S.prefix("seq", 5), F.repeat(F.lit("AC"), 3), S.suffix("seq", 5)).alias("built"))


@query(f"WITH {_READS} SELECT read_id, length(seq)::BIGINT AS size, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g'))::BIGINT AS hpc_size FROM reads")
def hpc_lengths(spark, d):
    return reads(spark, d).select("read_id", F.length("seq").cast("long").alias("size"), F.length(S.homopolymer_compress("seq")).cast("long").alias("hpc_size"))


@query(f"WITH {_READS} SELECT read_id, greatest(length(regexp_extract(seq, '^(A+|C+|G+|T+)', 0)) - 1, 0)::BIGINT AS left_run, greatest(length(regexp_extract(seq, '(A+|C+|G+|T+)$', 0)) - 1, 0)::BIGINT AS right_run FROM reads")
def end_run_lengths(spark, d):
    return reads(spark, d).select("read_id", S.left_run("seq").alias("left_run"), S.right_run("seq").alias("right_run"))


@query(f"WITH {_CONTIGS}, c AS (SELECT read_id, seq, unnest(range(0, length(seq))) AS p FROM contigs), f AS (SELECT read_id, p FROM c WHERE p = 0 OR substr(seq, p, 1) <> substr(seq, p + 1, 1)) SELECT read_id, (row_number() OVER (PARTITION BY read_id ORDER BY p) - 1)::BIGINT AS cpos, p::BIGINT AS pos FROM f")
def run_coordinates(spark, d):
    return contigs(spark, d).select("read_id", F.posexplode(S.run_starts("seq")).alias("cpos", "pos")).select("read_id", F.col("cpos").cast("long").alias("cpos"), F.col("pos").cast("long").alias("pos"))


_NEXT = f"WITH {_CONTIGS}, two AS (SELECT a.read_id, a.seq AS a, b.seq AS b FROM contigs a JOIN contigs b ON b.read_id = a.read_id + 1)"


def _next(spark, d):
    c = contigs(spark, d)
    return c.select("read_id", F.col("seq").alias("a")).join(c.select((F.col("read_id") - 1).alias("read_id"), F.col("seq").alias("b")), "read_id")


@query(f"{_NEXT} SELECT read_id, levenshtein(a, b)::BIGINT AS edits FROM two")
def edit_distance_pairs(spark, d):
    return _next(spark, d).select("read_id", F.levenshtein("a", "b").cast("long").alias("edits"))


@query(f"{_NEXT} SELECT read_id, starts_with(a, left(b, 1)) AS same_first, suffix(a, right(b, 2)) AS same_last, left(a, least(length(a), length(b))) = left(b, least(length(a), length(b))) AS agree, substr(a, 6, 3) = substr(b, 6, 3) AS same_inside, a || '~' < b || '~' AS smaller FROM two")
def prefix_relations(spark, d):
    a, b = F.col("a"), F.col("b")
    return _next(spark, d).select("read_id", F.startswith(a, F.left(b, F.lit(1))).alias("same_first"), F.endswith(a, F.right(b, F.lit(2))).alias("same_last"), S.non_contradicting("a", "b").alias("agree"), S.contains_at("a", F.substring("b", 6, 3), F.lit(5)).alias("same_inside"), (S.order_key("a") < S.order_key("b")).alias("smaller"))


@query(f"{_NEXT}, p AS (SELECT read_id, a, b, unnest(range(0, least(length(a), length(b)) + 1)) AS n FROM two) SELECT read_id, max(n)::BIGINT AS common FROM p WHERE left(a, n) = left(b, n) GROUP BY read_id")
def common_prefixes(spark, d):
    return _next(spark, d).select("read_id", S.common_prefix("a", "b").alias("common"))


@query(f"WITH {_CONTIGS}, {_km('contigs')}, c AS (SELECT DISTINCT canon FROM km) SELECT canon, list_sum([(instr('ACGT', substr(canon, i, 1)) - 1) * (4::BIGINT ** ({K} - i))::BIGINT for i in range(1, {K + 1})])::BIGINT AS number, right('0000000000' || (length(canon)::VARCHAR), 4) AS size FROM c")
def kmer_numbers(spark, d):
    return kmers.kmers(contigs(spark, d), K).select("canon").distinct().select("canon", S.base4("canon").alias("number"), S.padded(F.length("canon"), 4).alias("size"))


@query("SELECT doc_id, len(string_split(text, ' '))::BIGINT AS parts, array_to_string(list_reverse(string_split(text, ' ')), '_') AS turned, trim(text) AS trimmed, translate(source, '0123456789', '##########') AS masked, lpad(doc_id::VARCHAR, 12, '0') AS padded FROM documents")
def text_helpers(spark, d):
    t = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("parts"), F.array_join(F.reverse(t), "_").alias("turned"), F.trim("text").alias("trimmed"), F.translate("source", "0123456789", "##########").alias("masked"), S.padded("doc_id", 12).alias("padded"))


@query(f"WITH {_READS}, n AS (SELECT read_id, length(seq)::BIGINT AS size FROM reads) SELECT least(size // 100, 100)::BIGINT AS bin, count(*) AS n_reads, sum(size)::BIGINT AS total, arg_min(read_id, (size, read_id)) AS shortest FROM n GROUP BY 1")
def length_histogram(spark, d):
    n = reads(spark, d).select("read_id", F.length("seq").cast("long").alias("size"))
    return n.groupBy(F.least(F.floor(F.col("size") / 100), F.lit(100)).cast("long").alias("bin")).agg(F.count("*").alias("n_reads"), F.sum("size").alias("total"), F.min_by("read_id", F.struct("size", "read_id")).alias("shortest"))


@query("""WITH s AS (SELECT a.l_orderkey AS o, a.l_linenumber AS n, a.l_partkey AS l1, (a.l_partkey + a.l_quantity)::BIGINT AS r1, b.l_partkey AS l2, (b.l_partkey + b.l_quantity)::BIGINT AS r2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT o, n, 1000000 - r1 AS rc_left, 1000000 - l1 AS rc_right, greatest(0, l2 - r1, l1 - r2) AS gap, l1 < r2 AND l2 < r1 AS meets, greatest(0, least(r1, r2) - greatest(l1, l2)) AS shared, least(l1, l2) AS u_left, greatest(r1, r2) AS u_right, least(l1 + 10, r1) AS cut_left, greatest(r1 - 10, l1) AS cut_right FROM s""")
def segment_pairs(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("l"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("r"))
    two = li.toDF("o", "n", "l1", "r1").join(li.select("o", (F.col("n") - 1).alias("n"), F.col("l").alias("l2"), F.col("r").alias("r2")), ["o", "n"])
    x = [F.col(c) for c in ("l1", "r1", "l2", "r2")]
    rc, u = G.rc(x[0], x[1], F.lit(1000000)), G.unite(*x)
    return two.select("o", "n", rc[0].alias("rc_left"), rc[1].alias("rc_right"), G.distance(*x).alias("gap"), G.intersects(*x).alias("meets"), G.intersection_size(*x).alias("shared"), u[0].alias("u_left"), u[1].alias("u_right"), G.shrink_left(x[0], x[1], 10)[0].alias("cut_left"), G.shrink_right(x[0], x[1], 10)[1].alias("cut_right"))


@query(f"WITH {_READS} SELECT read_id, length(seq)::BIGINT AS size FROM reads WHERE length(seq) >= {K + W - 1}")
def long_reads(spark, d):
    return reads(spark, d).filter(F.length("seq") >= K + W - 1).select("read_id", F.length("seq").cast("long").alias("size"))


@query(f"WITH {_READS} SELECT read_id, length(seq)::BIGINT AS size, row_number() OVER (ORDER BY length(seq) DESC, seq, read_id)::BIGINT AS place FROM reads WHERE length(seq) > 1500")
def final_contigs(spark, d):
    """Sequences over 1500 letters by length, largest first; the places come from counts by length, not from one sorted task."""
    long = reads(spark, d).filter(F.length("seq") > 1500).withColumn("size", F.length("seq").cast("long"))
    by = Window.partitionBy("size").orderBy("seq", "read_id")
    before = long.groupBy("size").agg(F.count("*").alias("n"))
    larger = before.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return long.withColumn("at", F.row_number().over(by)).join(larger, "size").select("read_id", "size", (F.col("at") + F.col("above")).cast("long").alias("place"))


@query(f"WITH {_READS}, {_km('reads')} SELECT DISTINCT read_id FROM (SELECT read_id FROM km GROUP BY read_id, kmer HAVING count(*) > 1)")
def self_repeating_reads(spark, d):
    return kmers.codes(reads(spark, d), K).groupBy("read_id", "code").count().filter("count > 1").select("read_id").distinct()


# --- minimizers, anchors, hits -------------------------------------------------------------------

_MINI = f"""WITH {_READS}, {_km('reads')}, mm AS (SELECT read_id, pos, min(canon) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS minimizer, count(*) OVER (PARTITION BY read_id) AS n FROM km WHERE len >= {K + W - 1}),
mf AS (SELECT read_id, pos, minimizer, lag(minimizer) OVER (PARTITION BY read_id ORDER BY pos) AS before FROM mm WHERE pos <= n - {W}), mins AS (SELECT read_id, pos, minimizer FROM mf WHERE before IS NULL OR before <> minimizer)"""


@query(f"{_MINI} SELECT * FROM mins")
def minimizers(spark, d):
    return kmers.minimizers(reads(spark, d), K, W)


@query(f"{_MINI} SELECT DISTINCT minimizer FROM mins")
def minimizer_set(spark, d):
    return kmers.minimizer_codes(reads(spark, d), K, W).select("code").distinct().select(C.text(F.col("code"), K).alias("minimizer"))


_ANCHOR = f"""anchors AS (SELECT canon, arg_min(read_id, (read_id, pos)) AS read_id, arg_min(pos, (read_id, pos)) AS pos, arg_min(kmer = canon, (read_id, pos)) AS forward FROM
  (SELECT *, max(pos) OVER (PARTITION BY read_id) AS top FROM ckm) WHERE pos % {W} = 0 AND pos > 0 AND pos < top GROUP BY canon)"""


@query(f"WITH {_CONTIGS}, {_km('contigs', 'ckm')}, {_ANCHOR} SELECT * FROM anchors")
def anchors(spark, d):
    return kmers.anchors(contigs(spark, d), K, W)


@query(f"WITH {_READS}, {_CONTIGS}, {_km('reads')}, {_km('contigs', 'ckm')}, {_ANCHOR} SELECT km.read_id, km.pos, a.read_id AS contig, a.pos AS contig_pos, (km.kmer = km.canon) = a.forward AS same_strand FROM km JOIN anchors a USING (canon)")
def anchor_hits(spark, d):
    a = kmers.anchor_codes(contigs(spark, d), K, W).withColumnsRenamed({"read_id": "contig", "pos": "contig_pos"})
    return kmers.codes(reads(spark, d), K).join(a, "canon").select("read_id", "pos", "contig", "contig_pos", ((F.col("code") == F.col("canon")) == F.col("forward")).alias("same_strand"))


@query(f"WITH {_READS}, {_CONTIGS}, {_km('reads')}, {_km('contigs', 'ckm')} SELECT read_id, count(*) AS known FROM km SEMI JOIN ckm USING (canon) GROUP BY read_id")
def known_kmers(spark, d):
    c = kmers.codes(contigs(spark, d), K).select("canon")
    return kmers.codes(reads(spark, d), K).join(c, "canon", "left_semi").groupBy("read_id").agg(F.count("*").alias("known"))


@query(f"WITH {_READS}, {_CONTIGS}, {_km('reads')}, {_km('contigs', 'ckm')} SELECT DISTINCT km.read_id, c.read_id AS contig, c.pos - km.pos AS diagonal FROM km JOIN (SELECT * FROM ckm WHERE pos % {W} = 0) c ON km.kmer = c.kmer")
def seed_diagonals(spark, d):
    c = kmers.codes(contigs(spark, d), K).filter(F.col("pos") % W == 0).select(F.col("read_id").alias("contig"), F.col("pos").alias("cpos"), "code")
    return kmers.codes(reads(spark, d), K).join(c, "code").select("read_id", "contig", (F.col("cpos") - F.col("pos")).alias("diagonal")).distinct()


@query(f"""WITH {_READS}, {_CONTIGS}, {_km('reads')}, {_km('contigs', 'ckm')}, m AS (SELECT km.read_id, c.read_id AS contig, km.pos, c.pos - km.pos AS diagonal FROM km JOIN ckm c ON km.kmer = c.kmer),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id, contig, diagonal ORDER BY pos) AS run FROM m)
SELECT read_id, contig, min(pos) AS r_from, max(pos) + {K} AS r_to, min(pos) + diagonal AS c_from, max(pos) + {K} + diagonal AS c_to FROM i GROUP BY read_id, contig, diagonal, run""")
def diagonal_runs(spark, d):
    """Maximal exact matches of K letters or more between reads and contigs: seeds of one diagonal, joined while they follow each other."""
    c = kmers.codes(contigs(spark, d), K).select(F.col("read_id").alias("contig"), F.col("pos").alias("cpos"), "code")
    m = kmers.codes(reads(spark, d), K).join(c, "code").select("read_id", "contig", "pos", (F.col("cpos") - F.col("pos")).alias("diagonal"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("read_id", "contig", "diagonal").orderBy("pos"))
    ends = m.withColumn("run", run).groupBy("read_id", "contig", "diagonal", "run").agg(F.min("pos").alias("r_from"), (F.max("pos") + K).alias("r_to"))
    return ends.select("read_id", "contig", "r_from", "r_to", (F.col("r_from") + F.col("diagonal")).alias("c_from"), (F.col("r_to") + F.col("diagonal")).alias("c_to"))


@query(f"{SQL['diagonal_runs'].replace('WITH', 'WITH', 1).replace('SELECT read_id, contig, min(pos) AS r_from', ', runs AS (SELECT read_id, contig, min(pos) AS r_from', 1)}), s AS (SELECT runs.*, length(r.seq) AS rn, length(c.seq) AS cn FROM runs JOIN reads r ON r.read_id = runs.read_id JOIN contigs c ON c.read_id = runs.contig) SELECT read_id, contig, r_from, r_to, c_from, c_to, (cn - c_to)::BIGINT AS rc_from, (cn - c_from)::BIGINT AS rc_to, (r_from = 0 OR c_from = 0) AND (r_to = rn OR c_to = cn) AS good FROM s")
def alignment_quality(spark, d):
    """Matches that end only where the read or the contig does are good, the others partial; with reverse-strand coordinates."""
    rn = reads(spark, d).select("read_id", F.length("seq").alias("rn"))
    cn = contigs(spark, d).select(F.col("read_id").alias("contig"), F.length("seq").cast("long").alias("cn"))
    m = diagonal_runs(spark, d).join(rn, "read_id").join(cn, "contig")
    rc = G.rc(F.col("c_from"), F.col("c_to"), F.col("cn"))
    good = ((F.col("r_from") == 0) | (F.col("c_from") == 0)) & ((F.col("r_to") == F.col("rn")) | (F.col("c_to") == F.col("cn")))
    return m.select("read_id", "contig", "r_from", "r_to", "c_from", "c_to", rc[0].alias("rc_from"), rc[1].alias("rc_to"), good.alias("good"))


# --- the k-mer graph -----------------------------------------------------------------------------


@query(f"{_JG} SELECT * FROM junctions")
def junctions(spark, d):
    return kmers.junctions(reads(spark, d), K)


@query(f"{_JG}, {_LINKS} SELECT src, dst, label, count(*) AS n FROM links GROUP BY ALL")
def edges_between_junctions(spark, d):
    r = texts(spark, d)
    return packed.edges(r, packed.junctions(r, K))


@query(f"{_JG} SELECT kmer, count(*) AS visits FROM (SELECT kmer, lag(kmer) OVER (PARTITION BY read_id ORDER BY pos) AS before FROM km SEMI JOIN junctions USING (kmer)) WHERE before IS NULL OR before <> kmer GROUP BY kmer")
def vertex_coverage(spark, d):
    r = texts(spark, d)
    return packed.visits(r, packed.junctions(r, K))


@query(f"{_JG}, {_LINKS}, e AS (SELECT src, dst, label, count(*) AS n FROM links GROUP BY ALL), b AS (SELECT src, dst, n FROM e UNION ALL SELECT {_rc('dst')}, {_rc('src')}, n FROM e) SELECT src, dst, sum(n)::BIGINT AS cov FROM b GROUP BY src, dst")
def edge_coverage(spark, d):
    """Passes of both strands over the pairs of junctions."""
    r = texts(spark, d)
    return packed.coverage(r, packed.junctions(r, K))


@query(f"{_JG}, {_LINKS}, e AS (SELECT DISTINCT src, dst, label FROM links) SELECT e.src, e.dst, e.label, f.src IS NOT NULL AS has_twin, e.src || e.label = {_rc('e.src || e.label')} AS own_twin FROM e LEFT JOIN e f ON f.src || f.label = {_rc('e.src || e.label')}")
def edge_twins(spark, d):
    """Edges with whether their reverse complement is an edge too, and whether they are their own."""
    r = texts(spark, d)
    return packed.twins(r, packed.junctions(r, K))


@query(f"{_JG}, {_LINKS}, e AS (SELECT DISTINCT src, dst, label FROM links), {_DEG.format('e')} SELECT vertex, in_deg, out_deg, CASE WHEN in_deg = 0 OR out_deg = 0 THEN 'tip' WHEN in_deg = 1 AND out_deg = 1 THEN 'unbranching' ELSE 'junction' END AS kind FROM deg")
def vertex_kinds(spark, d):
    r = texts(spark, d)
    return packed.degrees(r, packed.junctions(r, K)).withColumn("kind", graph.kind())


@query(f"{_JG}, h AS (SELECT read_id, pos, kmer, lag(kmer) OVER w AS k0, lead(kmer) OVER w AS k2, pos - lag(pos) OVER w AS d0, lead(pos) OVER w - pos AS d2 FROM km SEMI JOIN junctions USING (kmer) WINDOW w AS (PARTITION BY read_id ORDER BY pos)) SELECT read_id, pos, kmer FROM h WHERE NOT coalesce(k0 = kmer AND k2 = kmer AND d0 = d2 AND d0 < {K}, false)")
def steady_hits(spark, d):
    """Vertex hits without the inner ones of a periodic self-overlap."""
    r = texts(spark, d)
    return packed.steady_hits(r, packed.junctions(r, K))


@query(f"{_JG}, {_LINKS}, e AS (SELECT DISTINCT src, dst, label FROM links) SELECT a.src, a.dst AS mid, b.dst, a.label || b.label AS label FROM e a JOIN e b ON a.dst = b.src")
def passages(spark, d):
    """Edges into a vertex with edges out of it; at most four of each, as the letter next to a junction fixes the way to the next one."""
    r = texts(spark, d)
    return packed.passages(r, packed.junctions(r, K))


@query()
def unitigs(spark, d):
    """Maximal unbranching strings of the documents' k-mer graph."""
    return compact.unitigs(texts(spark, d), K)


# --- the trade graph -----------------------------------------------------------------------------


@query(f"WITH {_TRADE}, {_DEG.format('trade')} SELECT in_deg, out_deg, count(*) AS vertices FROM deg GROUP BY ALL")
def degree_matrix(spark, d):
    return graph.degree_matrix(trade(spark, d))


@query(f"WITH {_TRADE}, {_DEG.format('trade')} SELECT count(*) AS vertices, (count(*) FILTER (in_deg = 0 OR out_deg = 0))::BIGINT AS tip, (count(*) FILTER (in_deg = 1 AND out_deg = 1))::BIGINT AS unbranching, (count(*) FILTER (in_deg > 0 AND out_deg > 0 AND NOT (in_deg = 1 AND out_deg = 1)))::BIGINT AS junction, (SELECT count(*) FROM trade) AS edges, (SELECT sum(len)::BIGINT FROM trade) AS total_len FROM deg")
def graph_stats(spark, d):
    return graph.stats(trade(spark, d))


@query(f"WITH {_TRADE} SELECT least(cov, 200)::BIGINT AS cov, count(*) AS edges, sum(len)::BIGINT AS total_len FROM trade GROUP BY 1")
def coverage_histogram(spark, d):
    return graph.coverage_histogram(trade(spark, d))


@query(f"WITH {_TRADE}, p AS (SELECT 'p' || p_partkey AS dst, p_size > 25 AS known FROM part) SELECT least(cov, 200)::BIGINT AS cov, (count(*) FILTER (known))::BIGINT AS known, (count(*) FILTER (NOT known))::BIGINT AS other FROM trade JOIN p USING (dst) GROUP BY 1")
def reference_histogram(spark, d):
    """Coverage histogram of edges on known (large) parts and of the others."""
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("dst"), (F.col("p_size") > 25).alias("known"))
    return trade(spark, d).join(p, "dst").groupBy(F.least("cov", F.lit(200)).alias("cov")).agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("other"))


_LINES = "lines AS (SELECT l_orderkey || '-' || l_linenumber AS eid, 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_quantity::BIGINT AS len, l_linenumber::BIGINT AS cov FROM lineitem)"


@query(f"WITH {_LINES} SELECT src, dst, min(cov) AS min_cov, max(cov) AS max_cov, sum(len)::BIGINT AS total_len FROM lines GROUP BY src, dst HAVING count(*) = 2")
def parallel_edges(spark, d):
    return graph.parallel_edges(lines(spark, d))


@query(f"WITH {_LINES} SELECT src, dst, sum(len)::BIGINT AS total_len FROM lines GROUP BY src, dst HAVING count(*) = 2 AND min(cov) >= 2 AND max(cov) <= 5")
def bulge_lengths(spark, d):
    return graph.parallel_edges(lines(spark, d)).filter("min_cov >= 2 AND max_cov <= 5").select("src", "dst", "total_len")


_BULGE = f"WITH {_LINES}, r AS (SELECT *, count(*) OVER w AS n, sum(cov) OVER w AS total, first_value(eid) OVER (PARTITION BY src, dst ORDER BY cov DESC, eid) AS best FROM lines WINDOW w AS (PARTITION BY src, dst)), p AS (SELECT l_orderkey AS path_id, l_linenumber::BIGINT AS ord, l_orderkey || '-' || l_linenumber AS eid FROM lineitem)"


@query(f"{_BULGE} SELECT path_id, ord, coalesce(b.best, p.eid) AS eid FROM p LEFT JOIN (SELECT eid, best FROM r WHERE n = 2 AND total < 8 AND eid <> best) b ON p.eid = b.eid")
def bulge_collapse(spark, d):
    """Orders as paths of their lines, each lighter line of a weak pair replaced by the heavier."""
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").cast("long").alias("ord"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("eid"))
    return graph.collapse_bulges(lines(spark, d), p, 8)


@query(f"WITH {_TRADE} SELECT src, dst, len, cov FROM trade WHERE cov >= 2 AND src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) AND dst IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10)")
def induced_subgraph(spark, d):
    v = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("vertex")).unionByName(table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("vertex")))
    return graph.induced(trade(spark, d).filter("cov >= 2"), v)


_ORDERS = "e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, l_quantity::BIGINT AS len FROM lineitem WHERE l_quantity >= 50)"
_COMP = f"WITH RECURSIVE {_ORDERS}, b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e), r AS (SELECT u AS vertex, u AS root FROM b UNION SELECT b.v, r.root FROM r JOIN b ON r.vertex = b.u), comp AS (SELECT vertex, min(root) AS component FROM r GROUP BY vertex)"


def _large_lines(spark, d):
    return _order_lines(spark, d, 50)


def _order_lines(spark, d, least: int = 0):
    """Edges order -> part of the lines with a quantity of ``least`` or more, once for each quantity."""
    return table(spark, d, "lineitem").filter(F.col("l_quantity") >= least).select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("len")).distinct()


@query(f"{_COMP} SELECT * FROM comp")
def components(spark, d):
    """Components of orders and parts after cutting the lines of less than fifty pieces."""
    return graph.connected_components(_large_lines(spark, d), a="src", b="dst")


@query(f"{_COMP}, {_DEG.format('e')} SELECT c.component, count(*) AS vertices, (count(*) FILTER (in_deg = 0 OR out_deg = 0))::BIGINT AS tips, (SELECT count(*) FROM e JOIN comp x ON e.src = x.vertex WHERE x.component = c.component) AS edges, (SELECT sum(len)::BIGINT FROM e JOIN comp x ON e.src = x.vertex WHERE x.component = c.component) AS total_len FROM deg JOIN comp c USING (vertex) GROUP BY c.component")
def component_sizes(spark, d):
    return graph.component_sizes(_large_lines(spark, d))


@query(f"WITH RECURSIVE {_ORDERS}, b AS (SELECT src AS u, dst AS v, len FROM e UNION ALL SELECT dst, src, len FROM e), r AS (SELECT 'p' || p_partkey AS vertex, 0::BIGINT AS dist FROM part WHERE p_size = 1 UNION SELECT b.v, r.dist + b.len FROM r JOIN b ON r.vertex = b.u WHERE r.dist + b.len <= 150) SELECT vertex, min(dist) AS dist FROM r GROUP BY vertex")
def neighbourhood(spark, d):
    """Distances up to 150 from the smallest parts over lines of fifty pieces, taken both ways."""
    return _near_parts(spark, d, _large_lines(spark, d))


def _near_parts(spark, d, e):
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "len"))
    seeds = table(spark, d, "part").filter("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("vertex"))
    return graph.distances(both, seeds, 150)


# the same over every line, without SQL: tests compare with brute force


@query()
def order_components(spark, d):
    """Components of orders and parts over all lines."""
    return graph.connected_components(_order_lines(spark, d), a="src", b="dst")


@query()
def order_component_sizes(spark, d):
    return graph.component_sizes(_order_lines(spark, d))


@query()
def order_neighbourhood(spark, d):
    """Distances up to 150 from the smallest parts over all lines, taken both ways."""
    return _near_parts(spark, d, _order_lines(spark, d))


@query()
def acyclic(spark, d):
    """Whether the event transitions hold no cycle."""
    return graph.is_acyclic(paths.transitions(event_paths(spark, d)).select(F.col("e1").alias("src"), F.col("e2").alias("dst")))


# --- paths ---------------------------------------------------------------------------------------


@query(f"WITH {_PATHS} SELECT e1, e2, count(*) AS n FROM (SELECT eid AS e1, lead(eid) OVER (PARTITION BY path_id ORDER BY ord) AS e2 FROM paths) WHERE e2 IS NOT NULL GROUP BY ALL")
def transitions(spark, d):
    return paths.transitions(event_paths(spark, d))


_SUF = f"WITH {_PATHS}, suf AS (SELECT eid, letters, count(*) AS n FROM (SELECT eid, left(eid, 1) || coalesce(lead(left(eid, 1), 1) OVER w, '') || coalesce(lead(left(eid, 1), 2) OVER w, '') || coalesce(lead(left(eid, 1), 3) OVER w, '') || coalesce(lead(left(eid, 1), 4) OVER w, '') AS letters FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY ord)) GROUP BY ALL), sup AS (SELECT eid, left(letters, i) AS prefix, sum(n)::BIGINT AS n FROM (SELECT *, unnest(range(1, length(letters) + 1)) AS i FROM suf) GROUP BY ALL)"


@query(f"{_SUF} SELECT * FROM suf")
def suffix_counts(spark, d):
    return paths.suffixes(event_paths(spark, d), 5)


@query(f"{_SUF} SELECT * FROM sup")
def prefix_support(spark, d):
    return paths.prefix_support(paths.suffixes(event_paths(spark, d), 5), 5)


@query(f"{_SUF}, st AS (SELECT eid, left(prefix, length(prefix) - 1) AS prefix, right(prefix, 1) AS letter, n FROM sup WHERE length(prefix) > 1) SELECT eid, prefix, arg_max(letter, (n, letter)) AS letter FROM st GROUP BY eid, prefix HAVING count(*) FILTER (n >= 3) = 1 AND count(*) FILTER (n > 1) = 1")
def unique_extension(spark, d):
    return paths.unique_extension(paths.prefix_support(paths.suffixes(event_paths(spark, d), 5), 5), 3, 1)


@query(f"{_SUF}, st AS (SELECT eid, left(prefix, length(prefix) - 1) AS prefix, right(prefix, 1) AS letter, n FROM sup WHERE length(prefix) > 1) SELECT eid, prefix, arg_max(letter, (n, letter)) AS letter, max(n) AS n FROM st GROUP BY eid, prefix")
def greedy_extension(spark, d):
    """The best supported next letter of every stored prefix."""
    s = paths.prefix_support(paths.suffixes(event_paths(spark, d), 5), 5).filter(F.length("prefix") > 1)
    return s.groupBy("eid", F.expr("left(prefix, length(prefix) - 1)").alias("prefix")).agg(F.max(F.struct("n", F.right("prefix", F.lit(1)).alias("letter"))).alias("m")).select("eid", "prefix", "m.letter", "m.n")


@query(f"{_SUF} SELECT eid, prefix AS letters, n FROM sup WHERE right(prefix, 1) = 'p' AND length(prefix) > 1 AND n >= 5")
def bulge_alternatives(spark, d):
    """Ways from an edge to the purchase letter with support of five or more."""
    return paths.prefix_support(paths.suffixes(event_paths(spark, d), 5), 5).filter((F.right("prefix", F.lit(1)) == "p") & (F.length("prefix") > 1) & (F.col("n") >= 5)).select("eid", F.col("prefix").alias("letters"), "n")


@query(f"{_SUF} SELECT eid, prefix AS letters, n FROM sup WHERE length(prefix) = 3 AND n >= 8")
def tip_alternatives(spark, d):
    """Suffixes of one length with support of eight or more."""
    return paths.prefix_support(paths.suffixes(event_paths(spark, d), 5), 5).filter((F.length("prefix") == 3) & (F.col("n") >= 8)).select("eid", F.col("prefix").alias("letters"), "n")


@query(f"WITH {_PATHS} SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord) AS ord, eid FROM paths WHERE eid <> 'click'")
def path_remove(spark, d):
    return paths.remove_edge(event_paths(spark, d), "click")


@query(f"WITH {_PATHS}, n AS (SELECT *, lead(eid) OVER (PARTITION BY path_id ORDER BY ord) AS nxt FROM paths), x AS (SELECT path_id, ord, 0 AS k, eid FROM n UNION ALL SELECT path_id, ord, 1, 'bridge' FROM n WHERE eid = 'view' AND nxt = 'click') SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord, k) AS ord, eid FROM x")
def path_add(spark, d):
    return paths.add_between(event_paths(spark, d), "view", "click", "bridge")


@query(f"WITH {_PATHS}, n AS (SELECT *, lag(eid) OVER (PARTITION BY path_id ORDER BY ord) AS prv FROM paths) SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY ord) AS ord, CASE WHEN eid = 'click' THEN 'view' ELSE eid END AS eid FROM n WHERE NOT (eid = 'click' AND coalesce(prv = 'view', false))")
def path_merge(spark, d):
    return paths.merge_pair(event_paths(spark, d), "view", "click")


@query("WITH p AS (SELECT l_orderkey AS path_id, l_linenumber::BIGINT AS ord, l_returnflag || l_linestatus AS eid FROM lineitem), c AS (SELECT eid, count(*) AS n FROM p GROUP BY eid), bad AS (SELECT eid FROM c WHERE n = (SELECT min(n) FROM c)) SELECT path_id, ord, eid FROM p WHERE path_id NOT IN (SELECT path_id FROM p SEMI JOIN bad USING (eid))")
def good_paths(spark, d):
    """Orders as paths of line states, without the paths that hold the rarest state."""
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").cast("long").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("eid"))
    c = p.groupBy("eid").agg(F.count("*").alias("n"))
    return paths.without_bad(p, c.join(c.agg(F.min("n").alias("n")), "n").select("eid"))


@query(f"WITH {_PATHS} SELECT path_id, first(eid ORDER BY ord) AS start, string_agg(left(eid, 1), '' ORDER BY ord) AS letters FROM paths GROUP BY path_id")
def compact_paths(spark, d):
    return paths.compact(event_paths(spark, d))


_CONV = "paths AS (SELECT conv_id AS path_id, turn AS ord, role AS eid FROM conversations), c AS (SELECT path_id, first(eid ORDER BY ord) AS start, string_agg(left(eid, 1), '' ORDER BY ord) AS letters FROM paths GROUP BY path_id)"


@query(f"WITH {_CONV}, p AS (SELECT start, left(letters, i) AS letters, count(*) AS supers FROM (SELECT *, unnest(range(1, length(letters) + 1)) AS i FROM c) GROUP BY ALL) SELECT path_id, supers FROM c JOIN p USING (start, letters) WHERE supers >= 2")
def subreads(spark, d):
    """Conversations whose turn of roles begins another one's."""
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("path_id"), F.col("turn").alias("ord"), F.col("role").alias("eid"))
    return paths.subreads(paths.compact(p))


@query(f"WITH {_PATHS}, n AS (SELECT path_id, ord, CASE WHEN ord % 7 = 0 THEN ord END AS r FROM paths) SELECT path_id, ord, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY ord ROWS UNBOUNDED PRECEDING), -1) AS last_reliable, coalesce(first_value(r IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS next_reliable FROM n")
def reliable_positions(spark, d):
    """The last and next reliable step of each step; every seventh is reliable."""
    by = Window.partitionBy("path_id").orderBy("ord")
    r = F.when(F.col("ord") % 7 == 0, F.col("ord"))
    return event_paths(spark, d).select("path_id", "ord", F.coalesce(F.last(r, True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)).alias("last_reliable"), F.coalesce(F.first(r, True).over(by.rowsBetween(0, Window.unboundedFollowing)), F.lit(-1)).alias("next_reliable"))


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, value FROM events), h AS (SELECT user_id, ord, lag(ord) OVER (PARTITION BY user_id ORDER BY ord) AS before FROM p WHERE value < 20),
n AS (SELECT *, sum(CASE WHEN ord - before - 1 <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS id FROM h) SELECT user_id, min(ord) AS first, max(ord) AS last, count(*) AS n FROM n GROUP BY user_id, id""")
def low_cov_regions(spark, d):
    """Runs of low values along each path; runs with two good steps or less between them are one."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, d, "events").select("user_id", F.row_number().over(by).cast("long").alias("ord"), "value")
    return intervals.islands(p, "user_id", "ord", F.col("value") < 20, 2)


@query(f"WITH {_PATHS}, c AS (SELECT eid, count(*) AS cov FROM paths GROUP BY eid) SELECT path_id, min(cov) AS min_cov, max(cov) AS max_cov FROM paths JOIN c USING (eid) GROUP BY path_id")
def path_coverage(spark, d):
    p = event_paths(spark, d)
    return p.join(p.groupBy("eid").agg(F.count("*").alias("cov")), "eid").groupBy("path_id").agg(F.min("cov").alias("min_cov"), F.max("cov").alias("max_cov"))


# --- segments and votes --------------------------------------------------------------------------


@query(f"WITH {_STRETCH}, {_UNION} SELECT sup, l AS \"left\", r AS \"right\", n FROM seg_u")
def covered_segments(spark, d):
    return intervals.union(stretches(spark, d), "sup")


@query(f"WITH {_STRETCH}, {_UNION} SELECT o.l_orderkey AS o, o.l_linenumber AS n, o.l_suppkey AS sup, o.l_partkey AS pos, u.l AS \"left\", u.r AS \"right\" FROM lineitem o JOIN seg_u u ON o.l_suppkey = u.sup AND u.l <= o.l_partkey AND o.l_partkey < u.r")
def edge_embedding(spark, d):
    """Each order line in the united segment that holds its part."""
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("sup"), F.col("l_partkey").alias("pos"))
    return intervals.embed(points, intervals.union(stretches(spark, d), "sup").drop("n"), "sup", 64).select("o", "n", "sup", "pos", "left", "right")


@query("WITH r AS (SELECT DISTINCT l_suppkey AS sup, l_partkey AS l FROM lineitem WHERE l_quantity >= 49), q AS (SELECT DISTINCT l_suppkey AS sup, l_partkey AS pos FROM lineitem) SELECT q.sup, q.pos, coalesce(min(r.l), -1) AS next_left FROM q LEFT JOIN r ON q.sup = r.sup AND r.l >= q.pos GROUP BY q.sup, q.pos")
def region_lookup(spark, d):
    """The next region at or after each position."""
    s = stretches(spark, d)
    regions = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_suppkey").alias("sup"), F.col("l_partkey").alias("left")).distinct()
    return intervals.next_region(s.select("sup", F.col("left").alias("pos")).distinct(), regions, "sup").withColumn("next_left", F.coalesce("next_left", F.lit(-1)))


@query("WITH v AS (SELECT l_partkey AS part, l_quantity::BIGINT AS vote, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem), c AS (SELECT part, list_sort(list(vote)) AS votes, count(*) AS n, avg(vote) AS mean FROM v WHERE k <= 21 GROUP BY part) SELECT part, n, votes[(1 + n) // 2] AS median, round(mean, 6) AS mean FROM c")
def vote_median(spark, d):
    """Median of the first 21 votes, slot (1 + n) div 2, and their mean."""
    by = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    v = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("vote"), F.row_number().over(by).alias("k")).filter("k <= 21")
    c = v.groupBy("part").agg(F.sort_array(F.collect_list("vote")).alias("votes"), F.count("*").alias("n"), F.avg("vote").alias("mean"))
    return c.select("part", "n", F.element_at("votes", F.expr("cast((1 + n) div 2 as int)")).alias("median"), F.round("mean", 6).alias("mean"))


@query("WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place FROM lineitem) SELECT l_suppkey AS sup, l_orderkey AS o, l_linenumber AS n, place::BIGINT AS place FROM v WHERE place <= 10")
def label_cap(spark, d):
    """The ten largest lines of every supplier."""
    by = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sup"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.row_number().over(by).cast("long").alias("place")).filter("place <= 10")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def top_paths(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def library_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def missing_edges(spark, d):
    """Parts that no large line visits."""
    seen = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("part"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part")).join(seen, "part", "left_anti")


@query(f"WITH {_TRADE}, {_DEG.format('trade')} SELECT t.src, t.dst, CASE WHEN len > 300 THEN 'unique' WHEN cov = 1 THEN 'error' WHEN cov < 3 THEN 'unreliable' ELSE 'repeat' END AS colour FROM trade t")
def edge_colours(spark, d):
    c = F.when(F.col("len") > 300, "unique").when(F.col("cov") == 1, "error").when(F.col("cov") < 3, "unreliable").otherwise("repeat")
    return trade(spark, d).select("src", "dst", c.alias("colour"))


@query(f"WITH {_TRADE} SELECT src, dst, len FROM trade WHERE len > 60")
def unique_edges_by_length(spark, d):
    return trade(spark, d).filter("len > 60").select("src", "dst", "len")


@query("SELECT 's' || s_suppkey AS edge, floor(s_acctbal)::BIGINT AS fwd, n_nationkey::BIGINT AS back, floor(s_acctbal / 1000.0 + 0.5)::BIGINT + floor(s_nationkey / 10.0 + 0.5)::BIGINT - 1 AS turns FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def loop_copy_number(spark, d):
    """Copies of a two-vertex loop from the coverage votes floor(cov / median + 1/2) of its two sides."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    turns = F.floor(F.col("s_acctbal") / 1000.0 + 0.5).cast("long") + F.floor(F.col("s_nationkey") / 10.0 + 0.5).cast("long") - 1
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("edge"), F.floor("s_acctbal").cast("long").alias("fwd"), F.col("n_nationkey").cast("long").alias("back"), turns.alias("turns"))


@query("SELECT r.item_id AS item, string_agg(repeat(substr(r.letters, i, 1), 1 + (i % 3)::INT), '' ORDER BY i) AS seq FROM (SELECT item_id, letters, unnest(range(1, length(letters) + 1)) AS i FROM (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS letters FROM benchmark)) r GROUP BY r.item_id")
def uncompressed_contigs(spark, d):
    """Contigs with each letter repeated by its run length (here 1 + position mod 3)."""
    n = F.length("seq")
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.repeat(F.substr("seq", i, F.lit(1)), (1 + i % 3).cast("int")))
    return contigs(spark, d).filter(n > 0).select(F.col("read_id").alias("item"), F.array_join(runs, "").alias("seq"))
