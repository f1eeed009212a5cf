"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and reread as the next stage's documents.
Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from strandloom.llm.common import crc_mod
from strandloom.llm.queries import read, tokenizer_path
from strandloom.plans import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model predicts toxic; it learns from the labels outside its held-out fold."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines; n_chars follows the text, and documents stay even if no line does."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each class of near copies."""
    return near_dup.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), short=True).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), {"ids_crc32": F.crc32("ids")}).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned weights, hashed signatures and the tokenizer have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
