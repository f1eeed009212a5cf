from strandloom.operators import kmers
from strandloom.streaming.kmer_counts import running_counts


def test_stream_equals_batch(spark, tmp_path):
    schema = "read_id long, seq string"
    for i in range(3):
        spark.createDataFrame([(10 * i + j, "ACGTTGCA" * (j + 1)) for j in range(3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_counts(stream, 5).writeStream.outputMode("complete").format("memory").queryName("kmer_stream").start()
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.sql("SELECT canon, n FROM kmer_stream").collect()}
    finally:
        q.stop()
    assert got == {tuple(r) for r in kmers.counts(spark.read.parquet(str(tmp_path / "in")), 5).collect()}
