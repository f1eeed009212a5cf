import random

from strandloom.operators import correct

RC = str.maketrans("ACGT", "TGCA")


def frame(spark, lists):
    return spark.createDataFrame([(k, i + 1, e) for k, v in lists.items() for i, e in enumerate(v)], "path_id long, ord long, eid string")


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["path_id"], r["ord"])):
        out.setdefault(r["path_id"], []).append(r["eid"])
    return out


EDGES = [("a", 1, 2, 10), ("b", 2, 3, 12), ("b2", 2, 3, 13), ("c", 3, 4, 9), ("d", 4, 5, 7), ("x", 2, 9, 5), ("y", 9, 3, 6)]


def test_precorrect_takes_the_only_reliable_edge(spark):
    lists = {i: ["a", "b", "c", "d"] for i in range(6)} | {9: ["a", "b2", "c"]}
    e = spark.createDataFrame(EDGES, "eid string, src long, dst long, len long")
    got = as_dict(correct.precorrect(frame(spark, lists), e, 3))
    assert got == {i: ["a", "b", "c", "d"] for i in range(6)} | {9: ["a", "b", "c"]}
    again = as_dict(correct.precorrect(frame(spark, got), e, 3))
    assert again == got


def test_replace_low_uses_the_supported_way(spark):
    lists = {i: ["a", "b", "c", "d"] for i in range(6)} | {9: ["a", "x", "y", "c", "d"]}
    e = spark.createDataFrame(EDGES, "eid string, src long, dst long, len long")
    got = as_dict(correct.replace_low(frame(spark, lists), e, 3))
    assert got[9] == ["a", "b", "c", "d"] and all(got[i] == lists[i] for i in range(6))


def test_simulated_errors_are_restored(spark):
    rng = random.Random(4)
    route = [f"e{i}" for i in range(30)]
    edges = [(f"e{i}", i, i + 1, 10) for i in range(30)] + [(f"w{i}", i, i + 1, 11) for i in range(30)]
    lists, truth = {}, {}
    for r in range(60):
        lo = rng.randrange(20)
        truth[r] = route[lo : lo + 10]
        lists[r] = list(truth[r])
    for r in rng.sample(range(60), 15):  # each wrong edge once, inside its read
        k = rng.randrange(2, 8)
        wrong = "w" + lists[r][k][1:]
        if not any(wrong in v for v in lists.values()):
            lists[r][k] = wrong
    p = frame(spark, lists)
    e = spark.createDataFrame(edges, "eid string, src long, dst long, len long")
    assert as_dict(correct.precorrect(p, e, 2)) == truth


def test_trim_and_regions(spark):
    lists = {1: ["a", "b", "c"], 2: ["a", "b", "c"], 3: ["q", "a", "b"], 4: ["a", "z", "b"]}
    assert as_dict(correct.trim_tips(frame(spark, lists))) == {1: ["a", "b", "c"], 2: ["a", "b", "c"], 3: ["a", "b"]}
    r = correct.low_regions(frame(spark, lists), 2, 0).collect()
    assert {(x["path_id"], x["first"], x["last"]) for x in r} == {(3, 1, 1), (4, 2, 2)}


def test_gap_patches_join_unique_ends(spark):
    rng = random.Random(5)
    g = "".join(rng.choice("ACGT") for _ in range(400))
    rc = lambda s: s.translate(RC)[::-1]
    other = "".join(rng.choice("ACGT") for _ in range(200))
    tips = [(1, g[:220]), (2, rc(g[170:])), (3, other)]
    got = correct.gap_patches(spark.createDataFrame(tips, "tip_id long, seq string"), 20, 200, 15, 0.05).collect()
    assert [(r["t1"], r["t2"], r["suffix"], r["prefix"]) for r in got] == [(1, 2, 50, 50)]


def test_rescue_and_loops(spark):
    e = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 3, 90.0), (2, 4, 5.0), (2, 5, 6.0)], "comp long, eid long, cov double")
    assert [(r["comp"], r["threshold"]) for r in correct.rescue_breaks(e).collect()] == [(1, 90.0)]
    f = spark.createDataFrame([(1, 2, 30)], "src long, dst long, cov long")
    b = spark.createDataFrame([(2, 1, 20)], "src long, dst long, cov long")
    m = spark.createDataFrame([(10.0,)], "median double")
    r = correct.loop_copies(f, b, m).first()
    assert (r["fwd_copies"], r["back_copies"], r["turns"]) == (3, 2, 2)
