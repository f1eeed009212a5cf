import random
from itertools import combinations

import numpy as np
import pytest

from strandloom.llm import near_dup as N


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Classes by all pairs: exact Jaccard of 4/5 or more."""
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if any(x and y and 5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: find(i) for i in ids}


def test_classes_match_all_pairs(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: r["class_id"] for r in N.classes(documents).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) < len(got) - 10


@pytest.mark.parametrize("hub_rounds", [0, 2])
def test_star_and_strays(spark, words, hub_rounds):
    """Variants that are near their source but not near each other are one class, whatever the smallest id."""
    rng = random.Random(4)
    base = [rng.choice(words) + str(i) for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        w = list(base)
        at = rng.sample(range(0, 200, 11), 3)
        for x in at:
            w[x] = f"v{i}-{x}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:100] + [f"n{i}-{j}" for j in range(40)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.classes(docs, hub_rounds=hub_rounds).collect()}
    assert got == brute(rows)


def test_keep_one_and_columns(documents):
    kept = N.keep_one(documents)
    assert kept.columns == documents.columns
    classes = {r["doc_id"]: r["class_id"] for r in N.classes(documents).collect()}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == set(classes.values())
    assert kept.filter("doc_id IS NULL").count() == 1


def test_empty(empty):
    assert N.classes(empty).collect() == []


def test_registers_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    common, a, b = (rng.integers(1, 2**62, n).astype(np.uint64) for n in (300, 100, 100))
    sets = [np.concatenate([common, a]), np.concatenate([common, b])]
    row = np.repeat([0, 1], [400, 400])
    reg = N.prob_minhash(row, np.concatenate(sets), np.ones(800), 2, 2000)
    assert abs((reg[0] == reg[1]).mean() - 300 / 500) < 0.05
    w = np.ones(800)
    w[:300] = w[400:700] = 5  # probability Jaccard: sum over common of 1 / sum of max(w_x / w_y ratios)
    reg = N.prob_minhash(row, np.concatenate(sets), w, 2, 2000)
    assert abs((reg[0] == reg[1]).mean() - 1500 / 1700) < 0.04
    one = N.prob_minhash(np.array([0]), np.array([7], np.uint64), np.ones(1), 2, 90)
    assert (one[0] == 7).all() and (one[1] == 0).all()


def test_repeat_counts_do_not_hide_links(spark, words):
    """Texts that differ in how often they hold a line are near copies if their shingle sets are."""
    rng = random.Random(12)
    rows = []
    for i in range(20):
        body = " ".join(rng.choice(words) + str(j) for j in range(100 + 100 * (i % 2)))
        line = " ".join(rng.choice(words) + "x" for _ in range(12 - 2 * (i % 2)))
        rows += [(3 * i + j, body + f" {line}" * n) for j, n in enumerate((40, 5, 1))]
    got = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) == 20
