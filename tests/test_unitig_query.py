"""The registered compaction covers the documents, benchmark or not."""

import random

from test_operators import brute_unitigs

from strandloom.operators import kmers
from strandloom.plans.queries import K, QUERIES


def test_unitigs_come_from_the_documents(spark, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(120)) for _ in range(6)]
    texts.append(texts[0][:60] + texts[1][60:])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, loops = brute_unitigs([r["seq"] for r in kmers.letter_reads(docs).collect()], K)
    assert not loops and {r["unitig"]: r["n"] for r in QUERIES["unitigs"](spark, str(tmp_path)).collect()} == want
