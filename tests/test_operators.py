import random

from strandloom.operators import graph, intervals, kmers
from strandloom.operators.variable_k import contigs, resolve

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def brute_unitigs(reads, k):
    """Maximal unbranching strings by walking, canonical strands only."""
    nxt, prv, n = {}, {}, {}
    for s in reads:
        for t in (s, rc(s)):
            for i in range(len(t) - k + 1):
                x = t[i : i + k]
                n[x] = n.get(x, 0) + 1
                if i:
                    prv.setdefault(x, set()).add(t[i - 1 : i - 1 + k])
                if i + k < len(t):
                    nxt.setdefault(x, set()).add(t[i + 1 : i + 1 + k])
    link = {}
    for x in n:
        y = nxt.get(x, set())
        if len(y) == 1:
            (y,) = y
            if len(prv.get(y, ())) == 1 and y != rc(x):
                link[x] = y
    back = {y: x for x, y in link.items()}
    out, seen = {}, set()
    for x in sorted(n):
        if x in back or x in seen:
            continue
        path = [x]
        while path[-1] in link:
            path.append(link[path[-1]])
        seen |= set(path)
        s = path[0] + "".join(p[-1] for p in path[1:])
        if s <= rc(s):
            out[s] = sum(n[p] for p in path)
    loops = {x for x in n if x not in seen}
    return out, loops


def test_unitigs_match_walking(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    reads = [genome[i : i + 80] for i in range(0, 520, 25)] + [rc(genome[100:180]), genome[200:240] + "A" * 9 + genome[300:340]]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    got = {r["unitig"]: r["n"] for r in graph.unitigs(df, 9).collect()}
    want, loops = brute_unitigs(reads, 9)
    assert not loops and got == want


def test_unitigs_of_a_circle(spark):
    rng = random.Random(6)
    circle = "".join(rng.choice("ACGT") for _ in range(60))
    reads = [(circle + circle)[i : i + 30] for i in range(0, 60, 5)]
    got = graph.unitigs(spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"), 9).collect()
    spelt = {r["unitig"] for r in got}
    km = {(circle * 2)[i : i + 9] for i in range(60)}
    have = {min(u[i : i + 9], rc(u[i : i + 9])) for u in spelt for i in range(len(u) - 8)}
    assert have == {min(x, rc(x)) for x in km} and all(r["kmers"] == 60 for r in got)


def test_kmer_set_is_kept_by_chunks(spark):
    rng = random.Random(7)
    reads = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 5, 10, 11, 99, 100, 101, 555])]
    df = spark.createDataFrame(reads, "read_id long, seq string")
    k = 11
    cut = kmers.chunks(df, 50, k - 1).selectExpr("read_id", "chunk AS seq")
    assert {r[0] for r in kmers.counts(cut, k).select("canon").collect()} == {r[0] for r in kmers.counts(df, k).select("canon").collect()}
    assert sum(r["n"] for r in kmers.counts(cut, k).collect()) == sum(r["n"] for r in kmers.counts(df, k).collect())


def test_interval_union_touches_and_is_idempotent(spark):
    df = spark.createDataFrame([("e", 0, 5), ("e", 5, 9), ("e", 12, 13), ("e", 1, 2), ("f", 3, 4)], "eid string, left long, right long")
    once = intervals.union(df, "eid")
    assert {(r["eid"], r["left"], r["right"], r["n"]) for r in once.collect()} == {("e", 0, 9, 3), ("e", 12, 13, 1), ("f", 3, 4, 1)}
    again = intervals.union(once.drop("n"), "eid")
    assert {(r["eid"], r["left"], r["right"]) for r in again.collect()} == {(r["eid"], r["left"], r["right"]) for r in once.collect()}


def test_resolve_by_component(spark):
    edges = [(0, 0, 2, "ACAAA"), (1, 1, 2, "GGAAA"), (2, 2, 3, "AATGC"), (3, 2, 4, "AATT"), (10, 20, 21, "ACGTTGCA")]
    e = spark.createDataFrame([(*x, False) for x in edges], "eid long, src long, dst long, seq string, is_unique boolean")
    p = spark.createDataFrame([("a", 0, 0), ("a", 1, 2), ("b", 0, 1), ("b", 1, 3)], "path_id string, ord int, eid long")
    v, out = resolve(e, p, 2, 3)
    assert {r["seq"] for r in out.collect()} == {"ACAAATGC", "GGAAATT", "ACGTTGCA"}
    assert {r["seq"] for r in v.collect()} == {"ACA", "GGA", "TGC", "ATT", "ACG", "GCA"}
    assert contigs(v, out).count() == 3
