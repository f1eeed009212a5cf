"""Unique edges and chains worked out by hand; partial matches against a scan letter by letter."""

import random

import pytest

from strandloom.functions import codes as C
from strandloom.operators import matches, unique
from pyspark.sql import functions as F

EDGES = "eid string, src string, dst string, len long, cov long"


def ids(df):
    return sorted(r["eid"] for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    rows = [("a", "1", "2", 50, 5), ("b1", "2", "3", 100, 2), ("b2", "2", "3", 110, 2), ("c", "3", "4", 10, 5), ("d1", "4", "5", 90, 1), ("d2", "4", "5", 91, 1), ("x", "5", "6", 40, 9), ("y", "5", "7", 45, 3)]
    return spark.createDataFrame(rows, EDGES)


def test_chains(spark, chain):
    got = {r["eid"]: r["chain"] for r in unique.bulge_chains(chain).collect()}
    assert got == dict.fromkeys(("a", "b1", "b2", "c", "d1", "d2"), "1>2") | {"x": "edge x", "y": "edge y"}
    s = {r["chain"]: r.asDict() for r in unique.chain_stats(unique.bulge_chains(chain)).collect()}
    assert s["1>2"] == {"chain": "1>2", "steps": 4, "bulges": 2, "len": 261, "single": 60, "widest": 110}
    assert ids(unique.diploid_unique(chain, 120, 60)) == ["b1", "b2", "d1", "d2"]
    assert ids(unique.diploid_unique(chain, 100, 200)) == ["x"]
    assert ids(unique.diploid_unique(chain.limit(0), 100, 200)) == []


def test_unequal_bulges_end_chains_and_loops_are_chains(spark):
    rows = [("a", "1", "2", 5, 1), ("b1", "2", "3", 100, 1), ("b2", "2", "3", 130, 1), ("c", "3", "4", 5, 1), ("o", "9", "9", 7, 1), ("p", "7", "8", 7, 1), ("q", "8", "7", 7, 1)]
    got = {r["eid"]: r["chain"] for r in unique.bulge_chains(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == {"a": "edge a", "b1": "edge b1", "b2": "edge b2", "c": "edge c", "o": "9>9", "p": "7>8", "q": "7>8"}


def test_long_and_error_edges(spark):
    rows = [("in", "1", "2", 90, 1), ("err", "5", "2", 3, 1), ("out", "2", "3", 80, 1), ("end", "3", "4", 20, 1), ("open", "8", "9", 20, 1)]
    df = spark.createDataFrame(rows, EDGES)
    long = unique.long_unique(df, 50)
    assert ids(long) == ["in", "open", "out"]
    assert ids(unique.error_edges(df, long)) == ["err"]
    assert ids(unique.error_edges(df, long.limit(0))) == []


def test_partial_matches(spark):
    rng, k = random.Random(4), 5
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    at = {}
    for i in range(len(genome) - k + 1):
        at.setdefault(genome[i : i + k], []).append(i)
    places = [p for p in sorted(rng.sample(range(len(genome) - k), 30)) if len(at[genome[p : p + k]]) == 1]
    edges = [(genome[a : a + k], genome[b : b + k], genome[a + k : b + k]) for a, b in zip(places, places[1:])]
    reads = []
    for i in range(40):
        a = rng.randrange(300)
        s = list(genome[a : a + 90])
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        reads.append((i, "".join(s)))
    reads += [(90, ""), (91, None), (92, "ACG")]
    vertices = {e[0] for e in edges} | {edges[-1][1]}
    want = []
    for i, s in reads:
        right = -1  # end of the last stretch
        for p in range(len(s or "") - k + 1):
            if s[p : p + k] not in vertices or p < right:
                continue
            for a, b, label in edges:
                text = (a + label)[: len(label)]
                if b == s[p : p + k] and p > right and p > 0 and text[-1] == s[p - 1]:
                    n = 0
                    while n < len(text) and n < p and text[-1 - n] == s[p - 1 - n]:
                        n += 1
                    want.append((i, p - n, p, a, b, len(label) - n, len(label)))
            for a, b, label in edges:
                if a == s[p : p + k] and s[p + k : p + k + 1] == label[0]:
                    n = 0
                    while n < len(label) and label[n] == s[p + k + n : p + k + n + 1]:
                        n += 1
                    want.append((i, p, p + n, a, b, 0, n))
                    right = p + n
    v = spark.createDataFrame([(x,) for x in vertices], "kmer string").select(C.code(F.col("kmer")).alias("code"))
    got = matches.partial_matches(spark.createDataFrame(reads, "read_id long, seq string"), v, spark.createDataFrame(edges, "src string, dst string, label string"), k)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100
