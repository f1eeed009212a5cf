import random

from strandloom.operators import align, graph
from strandloom.plans import assembly
from strandloom.sources import fastx

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def simulated(seed=9):
    """A genome with a repeat that reads span, and reads of both strands with some wrong letters."""
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    repeat = part(60)
    genome = part(300) + repeat + part(300) + repeat + part(300)
    reads = []
    for i in range(0, len(genome) - 199, 10):
        r = genome[i : i + 200]
        if rng.random() < 0.1:
            at = rng.randrange(40, 160)
            r = r[:at] + rng.choice([c for c in "ACGT" if c != r[at]]) + r[at + 1 :]
        reads.append(rc(r) if rng.random() < 0.5 else r)
    return genome, reads + [genome[-200:]]


def test_threads_spell_the_reads(spark):
    _, reads = simulated()
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    edges = align.both_strands(graph.unitigs(df, 22), 21).persist()
    paths = align.thread(df, edges, 21)
    assert {(r["path_id"], r["seq"]) for r in align.spell(paths, edges, 21).collect()} == set(enumerate(reads))
    cov = {r["eid"]: r["cov"] for r in align.edge_coverage(paths, edges).collect()}
    total = sum(cov[r["eid"]] * r["len"] for r in edges.collect())
    assert round(total) == sum(len(r) - 21 for r in reads)


def test_genome_comes_back_and_phases_restart(spark, tmp_path):
    genome, reads = simulated()
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    out = str(tmp_path / "asm")
    contigs = assembly.assemble(df, out, k=21, min_cov=3.0, saturating_k=120)
    seqs = [r["seq"] for r in contigs.collect()]
    assert all(s in genome or rc(s) in genome for s in seqs)
    assert max(map(len, seqs)) > 800
    before = {p: (tmp_path / "asm" / p / "_SUCCESS").stat().st_mtime_ns for p in assembly.PHASES}
    again = assembly.assemble(df, out, k=21, min_cov=3.0, saturating_k=120)
    assert sorted(r["seq"] for r in again.collect()) == sorted(seqs)
    assert before == {p: (tmp_path / "asm" / p / "_SUCCESS").stat().st_mtime_ns for p in assembly.PHASES}
    assembly.write_results(out, contigs, 21)
    assert {r["seq"] for r in fastx.read_fasta(spark, f"{out}/contigs.fa").collect()} == set(seqs)
