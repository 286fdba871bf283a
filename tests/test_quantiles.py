"""Exact percentiles and previous-row gaps: NULL keys, infinities, NaN, hot groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators.aggregates import with_exact_quantiles
from marketlens.operators import quantiles
from marketlens.operators.quantiles import exact_quantiles
from marketlens.operators.windows import days_since_previous


def cont(values, q):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    h = q * (len(v) - 1)
    lo, hi = v[math.floor(h)], v[math.ceil(h)]
    return lo if lo == hi or (math.isnan(lo) and math.isnan(hi)) else lo + (hi - lo) * (h - math.floor(h))


@pytest.mark.parametrize("cap, accuracy", [(0, 10_000), (12, 40), (50_000, 30), (50_000, 10_000)])
def test_groups_with_null_keys_and_odd_values(spark, cap, accuracy):
    r = np.random.default_rng(1)
    groups = {None: r.normal(size=400).tolist(), "hot": (r.normal(size=3000) * 1e6).round(2).tolist(),
              "inf": [float("inf")] * 30 + r.normal(size=200).tolist() + [float("-inf")] * 4,
              "nan": [float("nan")] * 3 + [1.0, 2.0, 3.0, 4.0], "one": [7.0] * 100, "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, 5e-324] * 4}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {x["g"]: [x[f"v_q{i}"] for i in range(len(qs))] for x in exact_quantiles(df, "v", qs, by="g", cap=cap, accuracy=accuracy).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for have, q in zip(got[k], qs):
            want = cont(vs, q)
            assert have == pytest.approx(want, rel=1e-12, nan_ok=True), (k, q)
    med = with_exact_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, "v", [0.5], "g", ["med"])
    assert {x["g"]: x["med"] for x in med.collect()}[None] == pytest.approx(cont(groups[None], 0.5))


def test_previous_row_of_a_null_key(spark):
    df = spark.createDataFrame([(None if i % 2 else i % 3, f"2024-01-{i % 28 + 1:02d}", i) for i in range(300)], "u int, d string, i int")
    df = df.withColumn("ts", F.to_timestamp("d"))
    a = days_since_previous(df, "u", "ts", "i", partitions=7)
    b = days_since_previous(df, "u", "ts", "i", skew_safe=False)
    assert sorted(map(tuple, a.select("i", "days_since_prev").collect())) == sorted(map(tuple, b.select("i", "days_since_prev").collect()))


@pytest.mark.parametrize("kind", ["cont", "disc"])
def test_hot_group_over_the_cap_takes_more_rounds(spark, monkeypatch, kind):
    """A group whose bracket may exceed the cap is searched on inside it; the
    counts are exact whatever the sketch says."""
    rounds = []
    real = quantiles._later_rounds
    monkeypatch.setattr(quantiles, "_later_rounds", lambda *a: rounds.append(1) or real(*a))
    df = spark.range(0, 40000, 1, 6).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
                                            (F.pmod(F.xxhash64("id"), F.lit(30011)) / 7).alias("v"))
    qs = [0.0, 0.013, 0.5, 0.99, 1.0]
    got = {r["g"]: list(r)[1:] for r in exact_quantiles(df, "v", qs, by="g", kind=kind, cap=40, accuracy=1000).collect()}
    assert rounds
    byg = {}
    for r in df.collect():
        byg.setdefault(r["g"], []).append(r["v"])
    assert set(got) == set(byg)
    for g, vs in byg.items():
        want = [cont(vs, q) if kind == "cont" else sorted(vs)[max(0, math.ceil(q * len(vs)) - 1)] for q in qs]
        assert got[g] == pytest.approx(want, rel=1e-12), g


def test_a_group_under_the_bound_takes_two_passes(spark, monkeypatch):
    """No search state is written and no later round runs."""
    written = []
    real = quantiles.write_through
    monkeypatch.setattr(quantiles, "write_through", lambda df, tag: written.append(tag) or real(df, tag))
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), F.sqrt("id").alias("v"))
    assert exact_quantiles(df, "v", [0.1, 0.5, 0.9], by="g").count() == 7
    assert written == ["quantiles"]


def test_two_values_many_rows_in_a_bracket(spark):
    """An interval whose ends are its only values needs no gather."""
    df = spark.range(4000).select((F.col("id") % 2).cast("double").alias("v"))
    assert list(exact_quantiles(df, "v", [0.49, 0.5, 0.51], cap=0, accuracy=50).first()) == [0.0, 0.5, 1.0]


def test_no_rows_and_no_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    assert [tuple(r) for r in exact_quantiles(df, "v", [0.5], by="g").collect()] == [("b", 1.0)]
    assert [tuple(r) for r in exact_quantiles(df.limit(0), "v", [0.5]).collect()] == [(None,)]
    assert exact_quantiles(df.limit(0), "v", [0.5], by="g").count() == 0


def test_one_value_held_by_most_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id") / 9).alias("v"))
    vs = [r["v"] for r in df.collect()]
    got = list(exact_quantiles(df, "v", [0.05, 0.5, 0.97], cap=3, accuracy=50).first())
    assert got == pytest.approx([cont(vs, q) for q in (0.05, 0.5, 0.97)])
