"""Unitigs cut from the reads against walking from k-mer to k-mer."""

import random
from collections import Counter

import pytest
from test_operators import brute_unitigs, rc

from strandloom.operators import compact, graph, kmers

K = 7


def rows(df):
    got = [tuple(r) for r in df.select("unitig", "kmers", "n").collect()]
    assert max(Counter(r[0] for r in got).values(), default=1) == 1
    return sorted(got)


def walked(reads, k):
    """``brute_unitigs`` with circles from their smallest canonical k-mer on, each once."""
    seqs = [s for s in reads if s]
    out, loops = brute_unitigs(seqs, k)
    n, after = Counter(), {}
    for s in seqs:
        for t in (s, rc(s)):
            for i in range(len(t) - k + 1):
                n[t[i : i + k]] += 1
                if i + k < len(t):
                    after[t[i : i + k]] = t[i + 1 : i + 1 + k]
    while loops:
        x = first = min(loops, key=lambda x: (min(x, rc(x)), x))
        s = x
        while after[x] != first:
            x = after[x]
            s += x[-1]
        circle = {s[i : i + k] for i in range(len(s) - k + 1)}
        out[s] = sum(n[x] for x in circle)
        loops -= circle | {rc(x) for x in circle}
    return sorted((s, len(s) - k + 1, m) for s, m in out.items())


def make(spark, seqs, parts=3):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(parts)


def some_reads(seed, size, n):
    rng = random.Random(seed)
    whole = "".join(rng.choice("ACGT") for _ in range(size))
    seqs = [whole[i : i + m] for i, m in ((rng.randrange(size - 20), rng.randrange(3, 90)) for _ in range(n))]
    seqs += [rc(x) for x in seqs[: n // 3]] + seqs[:5]
    return whole, seqs


@pytest.mark.parametrize("seed, size, n", [(1, 400, 60), (2, 400, 12), (3, 3000, 200), (4, 150, 30)])
def test_unitigs(spark, seed, size, n):
    whole, seqs = some_reads(seed, size, n)
    seqs += ["A" * 40 + "C", "ACACACACACACACACACAC", "ACGTACGTACGTACGTACGT", whole[:K], "", "GGG", None, "AGCATCGATGCT", "TTGCATCGATGCAA"]
    df = make(spark, seqs)
    assert rows(compact.unitigs(df, K)) == walked(seqs, K) == rows(graph.unitigs(df, K))


def test_no_read_spans_a_unitig(spark):
    whole = some_reads(8, 300, 3)[0]
    seqs = [whole[i : i + 24] for i in range(0, 280, 9)] + [rc(whole[i : i + 19]) for i in range(0, 280, 31)]
    got = rows(compact.unitigs(make(spark, seqs), 13))
    assert got == walked(seqs, 13) and max(r[1] for r in got) > 100


@pytest.mark.parametrize("seqs", [["A" * 20], ["ACC" * 9, "CCA" * 9], ["GTT" * 9]])
def test_periodic_reads(spark, seqs):
    assert rows(compact.unitigs(make(spark, seqs), K)) == walked(seqs, K)


def test_circles_come_once(spark):
    seqs, rng = [], random.Random(11)
    for size in (40, 61, 33, 57, 45):
        circle = "".join(rng.choice("ACGT") for _ in range(size)) * 2
        seqs += [(circle if size % 2 else rc(circle))[i : i + 25] for i in range(0, size, 4)]
    df = make(spark, seqs)
    want = walked(seqs, 11)
    assert rows(compact.unitigs(df, 11)) == want and len(want) == 5
    assert rows(graph.unitigs(df, 11)) == want


def test_other_letters_part_reads(spark):
    whole, seqs = some_reads(5, 500, 40)
    df = make(spark, [x[:30] + "N" + x[31:] for x in seqs])
    parted = [y for x in seqs for y in (x[:30] + "N" + x[31:]).split("N")]
    assert rows(compact.unitigs(df, K)) == walked(parted, K)


def test_small_steps(spark, monkeypatch):
    """Runs go on from one step's windows to the next."""
    whole, seqs = some_reads(6, 900, 40)
    import numpy as np

    from strandloom.functions import codes as C

    known = compact.ways(make(spark, [whole, *seqs]), K)
    data, off = np.frombuffer(whole.encode(), np.uint8), np.array([0, len(whole)])
    windows = C.windows

    def spelt():
        return [(int(x), int(y)) for r in compact._runs(data, off, known) for x, y in zip(r.a, r.b, strict=True)]

    want = spelt()
    monkeypatch.setattr(C, "windows", lambda d, o, k: windows(d, o, k, 5))
    assert spelt() == want and len(want) > 20


def test_many_cuts_are_sent_as_bits(spark):
    seqs = some_reads(7, 4000, 600)[1]
    df = make(spark, seqs)
    assert compact.ways(df, K).cuts.value.dense
    assert rows(compact.unitigs(df, K)) == walked(seqs, K)


def test_even_k_is_refused(spark):
    with pytest.raises(ValueError, match="odd"):
        compact.unitigs(make(spark, ["ACGT"]), 6)


def test_query_has_no_row_for_each_kmer(spark, tmp_path, monkeypatch):
    from strandloom.plans.queries import QUERIES

    docs = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog again and again" * (i + 1)) for i in range(5)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(kmers, "nodes", None)
    assert QUERIES["unitigs"](spark, str(tmp_path)).count() > 0


def test_a_circle_comes_on_one_strand(spark):
    """Also where the other strand's spelling is smaller than its own reverse complement."""
    rng, k = random.Random(3), 11
    while True:
        circle = "".join(rng.choice("ACGT") for _ in range(40)) * 2
        at = min(range(40), key=lambda i: min(circle[i : i + k], rc(circle[i : i + k])))
        if circle[at : at + k] < rc(circle[at : at + k]) < circle[at + 1 : at + 1 + k]:
            break
    seqs = [circle[i : i + 25] for i in range(0, 40, 4)]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    assert graph.unitigs(df, k).count() == 1 and rows(graph.unitigs(df, k)) == rows(compact.unitigs(df, k)) == walked(seqs, k)
