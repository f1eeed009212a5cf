import gzip

import pytest

from strandloom.sources import fastx, gfa


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fasta_wrapped_lower_crlf_gz(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">r1 first one\r\nacgt\r\nNN\r\n>r2\nTT\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">r3 x y\nAC\nGT\n")
    (tmp_path / "e.fa").write_bytes(b"")
    got = rows(fastx.read_fastx(spark, [str(tmp_path / n) for n in ("a.fa", "b.fasta.gz", "e.fa")]))
    assert got == [("r1", "first one", "ACGTNN"), ("r2", "", "TT"), ("r3", "x y", "ACGT")]


def test_fastq_drops_qualities_even_with_marks(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@q1 c\nACGT\n+\n@III\n@q2\nGG\nCC\n+q2\nIIII\n")
    assert rows(fastx.read_fastx(spark, str(tmp_path / "a.fq"))) == [("q1", "c", "ACGT"), ("q2", "", "GGCC")]


def test_unknown_suffix_and_missing_file(spark, tmp_path):
    with pytest.raises(ValueError, match="suffix"):
        fastx.read_fastx(spark, "x.txt")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fastx.read_fastx(spark, str(tmp_path / "none.fa"))


def test_fasta_round_trip_and_mask(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGTACGTA"), ("b", "C")], "read_id string, seq string")
    fastx.write_fasta(df, str(tmp_path / "o.fa"), width=4)
    assert rows(fastx.read_fasta(spark, str(tmp_path / "o.fa")).select("read_id", "seq")) == [("a", "ACGTACGTA"), ("b", "C")]
    assert [r[0] for r in df.select(fastx.mask_ends("seq", 2, 3)).collect()] == ["acGTACgta", "c"]


def test_gfa_and_dot(spark, tmp_path):
    e = spark.createDataFrame([(1, "AC", "GT", "ACGT", 3.0), (2, "GT", "TT", "GTT", 1.0)], "eid long, src string, dst string, seq string, cov double")
    gfa.write_gfa(e, str(tmp_path / "g"), 2)
    s, links = gfa.read_gfa(spark, str(tmp_path / "g"))
    assert rows(s) == [("1", "ACGT"), ("2", "GTT")] and rows(links) == [("1", "+", "2", "+", 2)]
    assert [(r["agrees"], r["flipped"]) for r in gfa.oriented_links(s, links).collect()] == [(True, False)]
    gfa.write_dot(e, str(tmp_path / "d"))
    assert rows(gfa.read_dot(spark, str(tmp_path / "d"))) == [("AC", "GT", 4, 3.0), ("GT", "TT", 3, 1.0)]
    v, both = gfa.edges_from_strings(s, 2)
    assert {r[0] for r in v.collect()} == {"AC", "GT", "TT", "AA"} and both.count() == 3


def test_path_text(spark, tmp_path):
    p = spark.createDataFrame([("r", "AC", True, "AGT", 1, 2), ("none", None, None, None, None, None)], "read_id string, start string, canonical boolean, letters string, lskip long, rskip long")
    gfa.write_paths(p, str(tmp_path / "p"))
    assert rows(gfa.read_paths(spark, str(tmp_path / "p")).filter("start IS NOT NULL")) == [("r", "AC", True, "AGT", 1, 2)]
    assert gfa.read_paths(spark, str(tmp_path / "p")).filter("start IS NULL").first()["letters"] == ""
