import itertools
import random

from strandloom.operators import flow, polish


def brute_bounds(edges, most):
    """Least and most flow of each edge over all circulations, by enumeration."""
    lo, hi = None, None
    for f in itertools.product(*[range(a, b + 1) for _, _, a, b in edges]):
        net = {}
        for (a, b, _, _), x in zip(edges, f):
            net[a] = net.get(a, 0) - x
            net[b] = net.get(b, 0) + x
        if not any(net.values()):
            lo = list(f) if lo is None else [min(x, y) for x, y in zip(lo, f)]
            hi = list(f) if hi is None else [max(x, y) for x, y in zip(hi, f)]
    return None if lo is None else list(zip(lo, hi))


def test_flow_bounds_match_enumeration():
    rng = random.Random(1)
    feasible = 0
    for _ in range(150):
        edges = []
        for _ in range(rng.randint(2, 6)):
            least = rng.randint(0, 1)
            edges.append((rng.randrange(4), rng.randrange(4), least, least + rng.randint(0, 2)))
        net = flow.Network()
        for e in edges:
            net.add(*e)
        want = brute_bounds(edges, 3)
        assert net.feasible() == (want is not None)
        if want:
            feasible += 1
            assert [net.bounds(k) for k in range(len(edges))] == want
    assert feasible > 30


def test_parallel_edges_share_a_unit():
    net = flow.Network()
    s = net.add(3, 0, 1, 1)
    a, b = net.add(0, 1, 0, 1), net.add(0, 1, 0, 1)
    net.add(1, 3, 1, 1)
    assert net.feasible() and net.bounds(a) == net.bounds(b) == (0, 1) and net.bounds(s) == (1, 1)


def test_strong_components_and_heaviest_path():
    c = flow.strong_components([(1, 2), (2, 3), (3, 2), (3, 4)])
    assert c[2] == c[3] and c[1] < c[2] < c[4]
    assert flow.heaviest_path([(0, 1, 2, 1.0), (1, 1, 3, 5.0), (2, 2, 4, 9.0), (3, 3, 4, 1.0)]) == [0, 2]


def test_edge_bounds_by_component(spark):
    # two unique ways into a repeat and out of it: the repeat has two copies
    rows = [(7, 0, 1, 3, True), (7, 1, 2, 3, True), (7, 2, 3, 4, False), (7, 3, 4, 5, True), (7, 4, 4, 6, True), (8, 5, 1, 2, False)]
    df = spark.createDataFrame(rows, "comp long, eid long, src long, dst long, unique boolean")
    got = {r["eid"]: (r["mult_lo"], r["mult_hi"]) for r in flow.edge_bounds(df, 10).collect()}
    assert got[2] == (2, 2) and got[0] == (1, 1) and got[5] == (1, 10)


def test_homopolymer_noise_is_voted_away(spark):
    rng = random.Random(2)
    compressed = "A"
    while len(compressed) < 120:
        x = rng.choice("ACGT")
        if x != compressed[-1]:
            compressed += x
    runs = [rng.randint(1, 4) for _ in compressed]
    truth = "".join(c * n for c, n in zip(compressed, runs))
    reads, al = [], []
    for i in range(15):
        lo, hi = rng.randint(0, 15), rng.randint(105, 120)
        noisy = "".join(c * max(1, n + (rng.random() < 0.15) - (rng.random() < 0.15)) for c, n in zip(compressed[lo:hi], runs[lo:hi]))
        reads.append((i, noisy))
        al.append((i, 1, 0, hi - lo, lo))
    v = polish.votes(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(al, "read_id long, contig_id long, r_from long, r_to long, c_from long"))
    out = polish.uncompress(spark.createDataFrame([(1, compressed)], "contig_id long, seq string"), polish.median_runs(v)).first()["seq"]
    assert sum(a != b for a, b in zip(out[20:-20], truth[20:-20])) == 0 or abs(len(out) - len(truth)) <= 3


def test_consensus_of_noisy_strings(spark):
    rng = random.Random(3)
    truth = "".join(rng.choice("ACGT") for _ in range(60))
    parts = []
    for _ in range(12):
        s = [c for c in truth]
        s[rng.randrange(5, 55)] = rng.choice("ACGT")
        if rng.random() < 0.5:
            del s[rng.randrange(5, 55)]
        else:
            s.insert(rng.randrange(5, 55), rng.choice("ACGT"))
        parts.append("".join(s))
    assert polish.consensus([*parts, "AC"]) == truth
    assert polish.consensus([]) == "" and polish.consensus(["ACGT"]) == "ACGT"
    df = spark.createDataFrame([(1, 0, 60, i, p) for i, p in enumerate(parts)], "contig_id long, left long, right long, read_id long, part string")
    assert polish.region_consensus(df).first()["seq"] == truth


def test_complex_regions(spark):
    df = spark.createDataFrame([(1, "CCCC" + "AT" * 12 + "GGGGGGGG" + "CA" * 11 + "T"), (2, "ACGT")], "contig_id long, seq string")
    assert [(r["contig_id"], r["left"], r["right"]) for r in polish.complex_regions(df).collect()] == [(1, 0, 59)]
