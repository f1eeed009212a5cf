"""The order graph's queries over all lines, against plain walks."""

import heapq
import random
from collections import defaultdict

import pytest

from strandloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("orders")
    rng = random.Random(3)
    rows = [(o, rng.randrange(60), float(rng.randint(1, 50))) for o in range(45) for _ in range(rng.randint(1, 2))]
    rows += rows[:3]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, 1 + p % 9) for p in range(60)], "p_partkey long, p_size int").write.parquet(f"{d}/part.parquet")
    return str(d), {(f"o{o}", f"p{p}", int(q)) for o, p, q in rows}


def _walk(edges, seeds, radius):
    near = defaultdict(list)
    for a, b, n in edges:
        near[a].append((b, n))
        near[b].append((a, n))
    best, heap = {}, [(0, s) for s in seeds]
    while heap:
        dist, v = heapq.heappop(heap)
        if v not in best:
            best[v] = dist
            for w, n in near[v]:
                if dist + n <= radius:
                    heapq.heappush(heap, (dist + n, w))
    return best


def test_components_and_sizes_of_all_lines(spark, folder):
    d, edges = folder
    vertices = {v for a, b, _ in edges for v in (a, b)}
    want = {v: min(_walk(edges, [v], 10**9)) for v in vertices}
    assert {r["vertex"]: r["component"] for r in QUERIES["order_components"](spark, d).collect()} == want
    sizes = defaultdict(lambda: [0, 0, 0])
    for v in vertices:
        sizes[want[v]][0] += 1
    for a, _, n in edges:
        sizes[want[a]][1] += 1
        sizes[want[a]][2] += n
    got = {r["component"]: [r["vertices"], r["edges"], r["total_len"]] for r in QUERIES["order_component_sizes"](spark, d).collect()}
    assert got == sizes and len(got) > 1


def test_distances_over_all_lines(spark, folder):
    d, edges = folder
    want = _walk(edges, [f"p{p}" for p in range(60) if p % 9 == 0], 150)
    assert {r["vertex"]: r["dist"] for r in QUERIES["order_neighbourhood"](spark, d).collect()} == want
