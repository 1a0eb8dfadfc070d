import time

from pyspark.sql import functions as F

from tessella.session import written


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_written_tables_leave_no_shuffle_files(spark):
    left = []
    for _ in range(4):
        df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n"))
        out = written(df.repartition(3, "n"), "test")
        time.sleep(1)  # files are deleted by another thread
        left.append(shuffle_files(spark))
        assert out.agg(F.sum("n")).first()[0] == 10_000 * 9_999 // 2
    assert sorted(left)[1] == 0, left  # in two of four at least: a collection may still come too early
