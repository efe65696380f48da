from pyspark.sql import functions as F
from rankloom.operators.tables import written


def test_written_tables_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name for i in range(files.getAllFiles().size()) if (name := files.getAllFiles().apply(i).getName()).startswith("shuffle_")}
    before = shuffles()
    out = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")))
    assert sorted(tuple(r) for r in out.collect()) == [(k, sum(range(k, 1000, 7))) for k in range(7)]
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
