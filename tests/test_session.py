import os

from leafmill import session


def test_tables_are_written_and_cleared(spark):
    df = session.materialise(spark.range(5))
    assert df.count() == 5
    path = session.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    local = [p.removeprefix("file:") for p in session._WRITTEN]
    assert len(local) >= 2 and all(os.path.isdir(p) for p in local[-2:])
    assert session.clear_tables(spark) >= 2 and not any(os.path.isdir(p) for p in local[-2:])
    assert session.clear_tables(spark) == 0


def test_small_inputs_are_spread(spark):
    assert session.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 4
    assert session.spread(spark.range(10, numPartitions=3)).rdd.getNumPartitions() == 3
