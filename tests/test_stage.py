"""Written tables leave no shuffle files behind."""

import os

from pyspark.sql import functions as F

from tapeloom.plans.stage import CLEANED, written


def shuffle_files(spark):
    found = set()
    jvm = spark.sparkContext._jvm
    roots = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    for root in roots:
        for folder, _, names in os.walk(root):
            found |= {os.path.join(folder, n) for n in names if n.startswith("shuffle_") and n.endswith(".data")}
    return found


def test_shuffle_files_go_with_their_write(spark):
    before, given = shuffle_files(spark), spark.conf.get(CLEANED, None)
    sums = spark.range(50_000).groupBy((F.col("id") % 1_000).alias("k")).agg(F.sum("id").alias("s"))
    held = written(sums, "sums")
    assert shuffle_files(spark) <= before
    assert held.count() == 1_000 and held.agg(F.sum("s")).first()[0] == sum(range(50_000))
    # a table that is read twice, and a stage that shuffles what was written
    again = written(held.join(held.groupBy("k").agg(F.max("s").alias("m")), "k").repartition(3), "again")
    assert again.filter("s = m").count() == 1_000 and spark.conf.get(CLEANED, None) == given
