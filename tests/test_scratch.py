from pathlib import Path

from strandloom.plans import scratch


def test_written_tables_live_in_the_shared_folder(spark):
    df, path = scratch.write(spark.range(10), "numbers")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 10 and Path(path, "_SUCCESS").exists()
    scratch.drop(spark, path)
    assert not Path(path).exists()
    again = scratch.cut(spark.range(3))
    assert again.count() == 3
    empty = scratch.cut(spark.createDataFrame([], "a long, b array<string>"))
    assert empty.count() == 0 and empty.columns == ["a", "b"]
