"""Written intermediates in the folder that the cluster shares.

Loops and multi-pass operators cut their lineage by writing a table and reading
it back, so a lost executor costs a re-read and not a re-run. The folder is the
one that ``spark.checkpoint.dir`` names; only a local session without that
setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder of this application's intermediates."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/strandloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def write(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder; return the reread frame and its path."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """``write`` for callers that keep the table until ``release``."""
    return write(df, name)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediates that no live frame reads."""
    for path in paths:
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete all intermediates of this application; frames built on them become unreadable."""
    _delete(spark, root(spark))
