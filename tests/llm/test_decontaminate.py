import random
import re
from itertools import combinations

import pytest

from strandloom.llm import decontaminate as D

WORD = re.compile(r"[^\W_]+")


def brute(doc, item):
    """True if any alignment has a window with few enough substitutions."""
    a, b = WORD.findall((doc or "").lower()), WORD.findall(item.lower())
    if len(b) < D.MIN_ITEM:
        return False
    w = min(D.WINDOW, len(b))
    for i in range(len(a) - w + 1):
        for j in range(len(b) - w + 1):
            if sum(x != y for x, y in zip(a[i : i + w], b[j : j + w])) <= D.allowed(w):
                return True
    return False


def test_seeds_hit_every_window_that_passes():
    for width in range(D.MIN_ITEM, D.WINDOW + 1):
        for subs in combinations(range(width), D.allowed(width)):
            assert any(all(p + o not in subs for o in seed) for seed in D.SEEDS for p in range(width - seed[-1])), (width, subs)


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_matches_brute_force(spark, words, block_words):
    rng = random.Random(9)
    few = words[:12]  # few words: many chance hits
    items = [(i, " ".join(rng.choice(words if i % 2 else few) for _ in range(rng.randint(5, 40)))) for i in range(25)] + [(90, None), (91, ""), (None, "a b c d e f g h i j")]
    docs = []
    for i in range(80):
        w = [rng.choice(words if i % 3 else few) for _ in range(rng.randint(10, 80))]
        if i % 2:
            src = items[i % 25][1].split()
            lo = rng.randrange(max(1, len(src) - 8))
            part = src[lo : lo + rng.randint(8, 25)]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "swapped"
            at = rng.randrange(len(w))
            w[at:at] = part
        docs.append((i, ", ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    docs += [(200, None), (201, ""), docs[7]]
    got = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words).collect())
    want = sorted((i, k) for i, t in docs for k, x in items if k is not None and x and brute(t, x))
    assert got == want and len(want) > 10


def test_clean_keeps_columns_and_empty_tables(documents, empty, spark):
    bench = spark.createDataFrame([(1, documents.filter("doc_id = 5").first()["text"])], "item_id long, text string")
    kept = D.clean(documents, bench)
    assert kept.columns == documents.columns and 5 not in {r["doc_id"] for r in kept.collect()}
    assert D.clean(empty, bench).count() == 0
    assert D.clean(documents, bench.limit(0)).count() == documents.count()


def test_overlap_place(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x y z " + item.replace("w7", "other") + " end")], "doc_id long, text string")
    r = D.contaminated(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).first()
    assert (r["n_words"], r["n_equal"], r["doc_from"], r["item_from"]) == (20, 19, 3, 0)


def test_short_items_and_other_scripts(spark):
    zh = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65"
    th = "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22\u0e2a\u0e27\u0e22\u0e07\u0e32\u0e21"
    quoted = "one two three four five six seven eight"
    items = [(1, "What is 12 + 30?"), (2, zh), (3, th), (4, quoted), (5, "!?"), (6, "alone")]
    docs = [
        (1, "so what is 12+30 then, what is 12 30"),
        (2, "what is 12 or 30"),
        (3, f"\u524d\u6587\u3002{zh[:6]}\uff0c{zh[6:]}\u3002\u540e\u6587"),
        (4, f"x{th}y"),
        (5, "\u201cone two\u201d\u2014three\u00a0four five\u2026six seven \u00abeight\u00bb"),
        (6, zh[:6]),
        (7, "ALONE, lonely"),
        (8, None),
    ]
    made = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_equal"], r["doc_from"]) for r in D.contaminated(*made, short=True).collect()}
    assert got == {(1, 1): (4, 4, 1), (3, 2): (13, 13, 2), (4, 3): (len(th), len(th), 1), (5, 4): (8, 8, 0), (7, 6): (1, 1, 0)}
    assert {r["doc_id"] for r in D.clean(*made, short=True).collect()} == {2, 6, 8}


def test_texts_of_few_different_words_are_cheap_and_exact():
    """Short periods on both sides: all alignments are found, by differences instead of pairs of places."""
    import time

    import pyarrow as pa

    rng = random.Random(6)
    for period in (1, 2, 3, 7):
        unit = [f"w{i}" for i in range(period)]
        item = (unit * 300)[:300]
        doc = (unit * 8000)[:8000]
        for _ in range(5):
            doc[rng.randrange(8000)] = "other"
        block = D.Block([4], pa.array([" ".join(item)]))
        spans = D.text_words(pa.array([" ".join(doc)]))
        began = time.time()
        (got,) = block.find(spans)
        assert time.time() - began < 3
        assert got[0]["n_equal"] >= 295 and got[0]["item_id"] == 4
    few = ["a", "b"]
    for _ in range(40):
        item = [rng.choice(few) for _ in range(rng.randint(8, 60))]
        doc = [rng.choice(few) for _ in range(rng.randint(1, 400))]
        (got,) = D.Block([1], pa.array([" ".join(item)])).find(D.text_words(pa.array([" ".join(doc)])))
        assert bool(got) == brute(" ".join(doc), " ".join(item))
        width = min(D.WINDOW, len(item))
        best = 0
        for shift in range(-len(item), len(doc)):
            same = [0 <= i + shift < len(doc) and doc[i + shift] == x for i, x in enumerate(item)]
            good = [i for i in range(len(item) - width + 1) if 0 <= i + shift and i + width + shift <= len(doc) and sum(same[i : i + width]) >= width - D.allowed(width)]
            best = max(best, sum(same[good[0] : good[-1] + width]) if good else 0)
        assert best == (got[0]["n_equal"] if got else 0)
