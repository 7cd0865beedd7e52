import os

from pyspark.sql import functions as F

from brightloom import session


def test_stored_tables(spark):
    df = session.stored(spark.range(10).withColumn("x", F.col("id") % 3), "t", "x")
    assert df.count() == 10 and df.columns == ["id", "x"]
    path = session._stored[-1].removeprefix("file://")
    assert os.path.isdir(path) and session.drop_stored(spark) >= 1 and not os.path.exists(path)


def test_small_and_spread(spark):
    df = spark.range(10)
    assert "broadcast" in session.small(df, 10)._jdf.queryExecution().logical().toString().lower() and session.small(df, 9) is df
    shuffled = df.groupBy("id").count()
    assert session.spread(shuffled) is shuffled
    assert session.spread(df.coalesce(1)).rdd.getNumPartitions() >= 2
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("  ",), ("a",)], "x string").select(session.blank("x")).collect()] == [True, True, True, False]
