"""Tables written for several reads."""

from pyspark.sql import functions as F

from zygospark.session import written


def test_written_table_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().shuffleManager()
    held = lambda: manager.shuffleBlockResolver().getStoredShuffles().size()
    before = held()
    table = written(spark.range(100_000).repartition(5, F.col("id") % 7).groupBy((F.col("id") % 11).alias("k")).count())
    assert held() == before and table.agg(F.sum("count")).first()[0] == 100_000
