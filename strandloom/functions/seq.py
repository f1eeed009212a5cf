"""Sequence functions as Column expressions: nucleotides, strands, k-mers, comparison keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import codes as C

LETTERS = "ACGT"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nucleotides(s: Column | str) -> Column:
    """Letters a-z in upper case, with the unknown letter N read as A."""
    return F.translate(_c(s), "abcdefghijklmnopqrstuvwxyzN", "ABCDEFGHIJKLMAOPQRSTUVWXYZA")


def is_nucleotides(s: Column | str) -> Column:
    return F.rlike(_c(s), F.lit("^[ACGTNacgtn]*$"))


def complement(s: Column | str) -> Column:
    return F.translate(_c(s), "ACGT", "TGCA")


def rev_comp(s: Column | str) -> Column:
    return F.reverse(complement(s))


def record_id(header: Column | str) -> Column:
    """A record's id: its header up to the first blank."""
    return F.substring_index(_c(header), " ", 1)


def record_comment(header: Column | str) -> Column:
    """What follows the first blank of a header, else empty."""
    h = _c(header)
    return F.when(F.instr(h, " ") > 0, F.substr(h, F.instr(h, " ") + 1)).otherwise("")


def prefix(s: Column | str, n: int | Column) -> Column:
    return F.left(_c(s), F.lit(n) if isinstance(n, int) else n)


def suffix(s: Column | str, n: int | Column) -> Column:
    return F.right(_c(s), F.lit(n) if isinstance(n, int) else n)


def non_contradicting(a: Column | str, b: Column | str) -> Column:
    """True if one sequence starts with the other."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    return F.left(a, n) == F.left(b, n)


def contains_at(s: Column | str, part: Column | str, pos: Column) -> Column:
    """True if ``part`` stands in ``s`` at the 0-based position."""
    return F.substr(_c(s), pos + 1, F.length(_c(part))) == _c(part)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))) | (i > n))
    return F.coalesce(F.try_element_at(at, F.lit(1)) - 1, n).cast("long")


def order_key(s: Column | str) -> Column:
    """Key of the graph's own order, in which a sequence follows its extensions: AC < A."""
    return F.concat(_c(s), F.lit("~"))


def is_canonical(s: Column | str) -> Column:
    """True if the sequence is not larger than its reverse complement."""
    return _c(s) <= rev_comp(s)


def canonical(s: Column | str) -> Column:
    return F.least(_c(s), rev_comp(s))


def base4(s: Column | str) -> Column:
    """The sequence as a number of base 4; up to 31 letters."""
    return F.conv(F.translate(_c(s), LETTERS, "0123"), 4, 10).cast("long")


def homopolymer_compress(s: Column | str) -> Column:
    """Each run of one letter as one letter."""
    return F.regexp_replace(_c(s), r"(.)\1+", "$1")


def left_run(s: Column | str) -> Column:
    """Letters beyond the first in the run at the left end."""
    return F.greatest(F.length(F.regexp_extract(_c(s), r"^(A+|C+|G+|T+)", 0)) - 1, F.lit(0)).cast("long")


def right_run(s: Column | str) -> Column:
    return F.greatest(F.length(F.regexp_extract(_c(s), r"(A+|C+|G+|T+)$", 0)) - 1, F.lit(0)).cast("long")


def run_starts(s: Column | str) -> Column:
    """0-based positions at which a run begins: the compressed coordinates in the original."""

    @F.arrow_udf("array<int>")
    def starts(col: pa.Array) -> pa.Array:
        return C.run_starts(col)

    return starts(_c(s))


def kmers(s: Column | str, k: int) -> Column:
    """All k-mers in order, as an array; empty for shorter sequences."""

    @F.arrow_udf("array<string>")
    def cut(col: pa.Array) -> pa.Array:
        return C.kmer_lists(col, k)

    return cut(_c(s))


def vertex_label(h: Column | str, digits: int = 7) -> Column:
    """Short label of a vertex: its number modulo 10**digits."""
    return F.pmod(_c(h), F.lit(10**digits)).cast("string")


def edge_label(src: Column | str, seq: Column | str) -> Column:
    """Label of an edge: its start and the first letter it adds."""
    return F.concat(_c(src).cast("string"), F.left(_c(seq), F.lit(1)))


def padded(n: Column | str, width: int) -> Column:
    """A number as text with leading zeros."""
    return F.lpad(_c(n).cast("string"), width, "0")
