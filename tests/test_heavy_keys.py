"""Joins with measured heavy keys: results equal the plain join, tasks are even."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators.joins import heavy_groups, heavy_keys, salted_join


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(0, 60000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") + 100).alias("k"),
        (F.col("id") % 5).alias("x"))
    right = spark.range(0, 70000, 1, 4).select((F.col("id") * 2 + 1).alias("k"), (F.col("id") % 9).alias("y")).union(
        spark.sql("select 7L, 100L"))
    return left, right


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_heavy_keys_are_found_with_their_share(spark, sides):
    left, _ = sides
    hot = heavy_keys(left, ["k"])
    exact = heavy_groups(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n")
    assert set(hot) == set(exact) and len(hot) == 2
    assert all(abs(hot[k] - exact[k]) < 0.01 for k in hot)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_the_plain_join(sides, how):
    left, right = sides
    got, want = salted_join(left, right, ["k"], how), left.join(right, ["k"], how)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_no_heavy_key_is_the_plain_join(spark):
    df = spark.range(1000).withColumn("x", F.lit(1))
    assert rows(salted_join(df, spark.range(500), ["id"])) == rows(df.join(spark.range(500), ["id"]))
    empty = df.limit(0)
    assert rows(salted_join(empty, df, ["id"])) == []


def test_repeated_identical_rows_and_two_keys(spark):
    left = spark.range(3000).select(F.lit("a").alias("k"), F.lit(1).alias("j"))
    right = spark.sql("select 'a' k, 1 j, 5 y union all select 'a', 1, 6 union all select 'b', 1, 7")
    assert salted_join(left, right, ["k", "j"]).count() == 6000


def test_outer_joins_of_the_right_side_are_refused(sides):
    with pytest.raises(ValueError):
        salted_join(*sides, ["k"], "full")


def test_no_task_reads_more_than_twice_the_median(spark, sides):
    left, right = sides
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        def sizes(df):
            n = sorted(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
            return n[-1], n[len(n) // 2]
        top, median = sizes(salted_join(left, right, ["k"], "left"))
        assert top <= 2 * median
        top, median = sizes(left.join(right, ["k"], "left"))
        assert top > 2 * median  # what the salts are for
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
