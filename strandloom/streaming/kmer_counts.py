"""Incremental k-mer counts over a stream of reads.

The stream's micro-batches are counted like a table (canonical k-mers, partial sums
first) and merged into a state that Spark keeps by k-mer, so results after any
number of batches equal the counts of all reads so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandloom.operators import kmers


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """``reads``: a streaming frame (read_id, seq); write the result in ``update`` or ``complete`` mode."""
    return kmers.counts(reads, k)
