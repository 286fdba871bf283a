"""Row numbers over range partitions equal the window over the whole key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators.windows import numbered


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_equals_the_window(spark, partitions):
    df = spark.range(0, 6000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, F.lit(50)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 90).alias("k"),
        F.when(F.col("id") % 5 > 0, F.pmod(F.xxhash64("id"), F.lit(40))).alias("t"), F.col("id"))
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long"))
    got = numbered(df, "k", ["t", "id"], "n", partitions)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_one_key_and_no_row(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), "id")
    assert [r["row_number"] for r in numbered(df, "k", ["id"], partitions=7).orderBy("id").collect()] == list(range(1, 1001))
    assert numbered(df.limit(0), "k", ["id"]).count() == 0
