"""Column helpers that several corpus operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key's decimal text, modulo ``n``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def hash_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows if they are at most ``bound``, else a hash sample that stays below it.

    The sample depends on the keys only: rows whose ``xxhash64(key)`` falls into
    the first share of the range. The share aims four standard deviations under
    the bound, so a larger result is as good as impossible; rows of one key stay
    or go together.
    """
    total = df.count()
    if total <= bound:
        return df
    share = max(bound - 4 * math.sqrt(bound), bound / 2) / total
    steps = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(steps)) < int(share * steps))


#: Rows, and bytes, of the batches that go between Spark and its Python workers, at most (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, where the session has larger ones.

    Spark's default of 10,000 rows holds tens to hundreds of MB of texts, on both sides
    of each running task.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        digits = spark.conf.get(key).rstrip("bB")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def project(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns never reach an operator. Texts then travel in ``bounded_batches``."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])
