import random

from strandloom.operators import components as C
from strandloom.operators import graph


def brute(edges, vertices):
    root = {v: v for v in vertices}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {v: find(v) for v in vertices}


def test_random_graphs_and_long_chains(spark):
    rng = random.Random(3)
    chain = list(range(1000, 1300))
    rng.shuffle(chain)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + list(zip(chain, chain[1:])) + [(5, 5), (900, 901), (901, 900)] + [(2000, 2000 + i) for i in range(1, 400)]
    want = brute(edges, {v for e in edges for v in e} | {7777})
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in C.connected_components(df, spark.createDataFrame([(7777,)], "vertex long")).collect()}
    assert got == {**want, 3: want.get(3, 3)}


def test_empty(spark):
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_acyclic_and_distances(spark):
    e = spark.createDataFrame([("a", "b", 2), ("b", "c", 2), ("a", "c", 9), ("c", "d", 1)], "src string, dst string, len long")
    assert graph.is_acyclic(e).first()["acyclic"]
    loop = e.unionByName(spark.createDataFrame([("d", "b", 1)], "src string, dst string, len long"))
    r = graph.is_acyclic(loop).first()
    assert (r["acyclic"], r["left_edges"]) == (False, 3)
    seeds = spark.createDataFrame([("a",)], "vertex string")
    assert {(r["vertex"], r["dist"]) for r in graph.distances(e, seeds, 4).collect()} == {("a", 0), ("b", 2), ("c", 4)}
