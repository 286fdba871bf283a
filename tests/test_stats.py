"""Distribution functions and tests against the published test vectors."""

import math

import pytest
from pyspark.sql import functions as F

from marketlens.functions.stats import normal_cdf, t_sf
from marketlens.operators.experiments import proportions_ztest, sample_size, welch_from_moments


def one(spark, df, col):
    return df.collect()[0][col]


def test_normal_cdf(spark):
    df = spark.createDataFrame([(1.96,), (0.0,), (-1.907,), (None,)], "z double")
    got = [r.p for r in df.select(normal_cdf("z").alias("p")).collect()]
    assert got[0] == pytest.approx(0.9750021, abs=1e-6)
    assert got[1] == pytest.approx(0.5, abs=1e-12)
    assert got[2] == pytest.approx(0.02826, abs=1e-5)
    assert got[3] is None


def test_t_tail(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.4028, 4000.0), (-2.0, 10.0), (50.0, 5.0)], "t double, df double")
    got = [r.p for r in df.select(t_sf("t", "df").alias("p")).collect()]
    assert got[0] == pytest.approx(0.0366940, abs=1e-6)
    assert got[1] == pytest.approx(0.3436, abs=1e-4)
    assert got[2] == pytest.approx(1 - 0.0366940, abs=1e-6)
    assert 0.0 <= got[3] < 1e-5


def test_ztest_vector(spark):
    # redesign test: 1377 of 4952 vs 1480 of 5011, one-sided 'smaller'
    c = spark.createDataFrame([(4952, 1377, 5011, 1480)], "n_a long, success_a long, n_b long, success_b long")
    r = proportions_ztest(c, "smaller").collect()[0]
    assert r.z_stat == pytest.approx(-1.907, abs=1e-3)
    assert r.p_value == pytest.approx(0.0282, abs=1e-4)
    assert r.enough_data is True


def test_welch_from_summary_rows(spark):
    m = spark.createDataFrame([(14192, 9.46, 68.04 ** 2, 4868, 7.04, 35.98 ** 2)],
                              "n_a long, mean_a double, var_a double, n_b long, mean_b double, var_b double")
    r = welch_from_moments(m, "greater").collect()[0]
    assert r.t_stat == pytest.approx(3.14, abs=0.01)
    assert r.p_value < 0.01


def test_sample_size_vectors(spark):
    df = spark.createDataFrame([(0.30,)], "p double")
    rel = df.select(sample_size(F.col("p"), F.lit(0.03), relative=True).alias("n")).collect()[0].n
    ab = df.select(sample_size(F.col("p"), F.lit(0.03), relative=False).alias("n")).collect()[0].n
    assert rel == pytest.approx(41040.8, abs=1.0)
    assert ab == pytest.approx(3761.6, abs=1.0)
    assert math.ceil(ab) == 3762
