"""FASTA and FASTQ, plain or gzipped, one file or many.

Records are split by Spark's text source (separator: line feed and the record
mark), so large plain files are read in parallel, any store that Spark reaches
works, and gzip is left to Hadoop's codec. Qualities are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq as S

_FASTA, _FASTQ = re.compile(r"\.(fa|fasta|fna)(\.gz)?$"), re.compile(r"\.(fq|fastq)(\.gz)?$")


def _record(header: Column, seq: Column) -> list[Column]:
    head = F.rtrim(F.replace(header, F.lit("\r"), F.lit("")))
    return [S.record_id(head).alias("read_id"), S.record_comment(head).alias("comment"), F.upper(F.regexp_replace(seq, r"\s", "")).alias("seq")]


def read_fasta(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(read_id, comment, seq); sequences may be wrapped, in any case and with CRLF."""
    raw = spark.read.text(paths, lineSep="\n>")
    text = F.regexp_replace("value", "^>", "")
    rows = raw.filter(F.length(F.trim("value")) > 0).select(text.alias("t"))
    return rows.select(*_record(F.substring_index("t", "\n", 1), F.when(F.instr("t", "\n") > 0, F.substr("t", F.instr("t", "\n") + 1)).otherwise("")))


def read_fastq(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(read_id, comment, seq). A quality line that starts with the record mark splits off a piece without a ``+`` line, which is no record."""
    raw = spark.read.text(paths, lineSep="\n@")
    text = F.regexp_replace("value", "^@", "")
    rows = raw.select(text.alias("t")).filter(F.rlike("t", F.lit(r"(?s)^[^\n]*\n.*?(^|\n)\+")))
    seq = F.split(F.substr("t", F.instr("t", "\n")), r"\n\+", 2)[0]
    return rows.select(*_record(F.substring_index("t", "\n", 1), seq))


def read_fastx(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files of both formats by their suffix, all their records; a missing file or unknown suffix fails at once."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fasta, fastq = [p for p in paths if _FASTA.search(p)], [p for p in paths if _FASTQ.search(p)]
    if odd := sorted(set(paths) - {*fasta, *fastq}):
        raise ValueError(f"not FASTA or FASTQ by suffix: {odd}")
    parts = [read(spark, p) for read, p in ((read_fasta, fasta), (read_fastq, fastq)) if p]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_fasta(reads: DataFrame, path: str, width: int = 0, key: str = "read_id") -> None:
    """One FASTA text folder; lines wrapped at ``width`` if given."""
    seq = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    reads.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), seq).alias("value")).write.text(path)


def mask_ends(seq: Column | str, left: int, right: int) -> Column:
    """The sequence with that many letters at its ends in lower case."""
    s = F.col(seq) if isinstance(seq, str) else seq
    n = F.length(s)
    a = F.least(F.lit(left), n)
    b = F.least(F.lit(right), n - a)
    return F.concat(F.lower(F.left(s, a)), F.substr(s, a + 1, n - a - b), F.lower(F.right(s, b)))
