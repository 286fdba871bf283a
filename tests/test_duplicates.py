"""Duplicates by digest: same rows as distinct(), a fraction of its shuffle."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import duplicates
from marketlens.operators.clean import dedupe_keep_first, drop_full_duplicates
from marketlens.operators.quality import duplicate_counts


def table(spark, n=3000):
    """Wide rows, 1 in 50 of them twice, one of them often; NULLs in each place."""
    df = spark.range(0, n, 1, 5).select(
        F.when(F.col("id") % 50 == 1, F.col("id") - 1).when(F.col("id") % 7 == 3, F.lit(3)).otherwise(F.col("id")).alias("k"))
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.lit(str(i)), F.col("k").cast("string")), 256) for i in range(4)])
    return df.select(F.when(F.col("k") % 5 > 0, F.col("k")).alias("a"), F.when(F.col("k") % 3 > 0, F.col("k")).alias("b"),
                     text.alias("text"), (F.col("k") / 4).alias("x"))


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_equals_distinct(spark, monkeypatch, bits):
    monkeypatch.setattr(duplicates, "BITS", bits)  # 64: nearly every row meets a set bit
    df = table(spark)
    assert rows(drop_full_duplicates(df)) == rows(df.distinct())
    c = duplicate_counts(df).first()
    assert (c["rows"], c["distinct_rows"], c["duplicates"]) == (3000, df.distinct().count(), 3000 - df.distinct().count())


def test_equal_digests_of_different_rows_are_compared(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "_digest", lambda cols: (F.lit(5).cast("long"), F.lit(5).cast("long")))
    df = table(spark, 400)
    assert rows(drop_full_duplicates(df)) == rows(df.distinct())
    assert duplicate_counts(df).first()["distinct_rows"] == df.distinct().count()


def test_nulls_and_special_numbers(spark):
    df = spark.createDataFrame([(None, "a", 0.0), (None, "a", -0.0), ("a", None, 0.0), ("a", None, float("nan")), ("a", None, float("nan")),
                                (None, None, None), (None, None, None)], "p string, q string, v double")
    assert rows(drop_full_duplicates(df)) == rows(df.distinct())
    assert duplicate_counts(df).first()["distinct_rows"] == 4
    empty = duplicate_counts(df.limit(0)).first()
    assert tuple(empty) == (0, 0, 0) and drop_full_duplicates(df.limit(0)).count() == 0


def test_keep_first_of_rare_repeats(spark):
    df = table(spark).withColumn("id", F.xxhash64("text", "x"))
    a, b = (dedupe_keep_first(df, ["a", "b", "text"], ["id"], rare=r) for r in (True, False))
    assert rows(a) == rows(b)


def test_narrow_keys_are_not_digested(spark):
    df = spark.range(100).select((F.col("id") % 9).alias("a"), (F.col("id") % 2).alias("b"))
    assert rows(drop_full_duplicates(df)) == rows(df.distinct())
    plan = drop_full_duplicates(df)._jdf.queryExecution().toString()
    assert "xxhash64" not in plan


def shuffled(spark, run):
    """Bytes written to shuffles while ``run`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_shuffles_a_fraction(spark, tmp_path):
    table(spark, 30000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    whole = shuffled(spark, lambda: df.distinct().write.format("noop").mode("overwrite").save())
    mine = shuffled(spark, lambda: drop_full_duplicates(df).write.format("noop").mode("overwrite").save())
    assert mine < whole / 3, (mine, whole)
