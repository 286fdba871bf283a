"""Operator unit tests on tiny frames holding the edge rows of FIXTURES.md section 4."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.functions.dates import month_name, season, weekday0
from marketlens.functions.numeric import numeric_round, safe_div
from marketlens.operators.aggregates import describe, sorted_distinct, totals_and_positive_counts, value_counts
from marketlens.operators.clean import dedupe_keep_first, impute_midpoint_date
from marketlens.operators.experiments import (chi_square_association, conversion_by_group, events_within,
                                              histogram, users_in_several_groups)
from marketlens.operators.joins import full_outer_on, join_unique
from marketlens.operators.metrics import retention
from marketlens.operators.outliers import Bound, cap_by_group_percentile, filter_by_global_percentiles, iqr_flag
from marketlens.operators.quality import duplicate_counts, duplicated_rows, null_profile
from marketlens.operators.windows import days_since_previous
from marketlens.plans.games import CRITIC_BINS, USER_BINS, left_closed_bins


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_value_counts_drops_null_key(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    vc = value_counts(df, "k", normalize=True)
    assert rows(vc, "k", "count") == [("a", 2), ("b", 1)]
    assert rows(vc, "k", "percent")[0][1] == pytest.approx(200 / 3)


def test_describe_single_row_group_std_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0), ("a", None)], "g string, v double")
    d = {r.g: r for r in describe(df, "v", by="g").collect()}
    assert set(d) == {"a", "b"}
    assert d["a"]["count"] == 2 and d["a"]["mean"] == 2.0 and d["a"]["q50"] == 2.0
    assert d["b"]["std"] is None


def test_percentile_bounds_strict_and_null_passes(spark):
    df = spark.createDataFrame([(float(i), None if i == 3 else float(200 - i)) for i in range(1, 101)],
                               "a double, b double")
    kept = filter_by_global_percentiles(df, [Bound("a", 0.99, "cont", "<", null_passes=False),
                                             Bound("b", 0.99, "disc", "<")])
    got = [r.a for r in kept.collect()]
    # p99 of a = 99.01 cuts a = 100; the discrete p99 of b is its maximum 199
    # (a = 1), cut because equal to the bound; the NULL b (a = 3) passes
    assert 100.0 not in got and 1.0 not in got and 3.0 in got and 99.0 in got and len(got) == 98


def test_group_cap_keeps_value_equal_to_cap(spark):
    df = spark.createDataFrame([("rub", float(v)) for v in range(1, 6)] + [("usd", 1.0)], "cur string, rev double")
    kept = cap_by_group_percentile(df, "rev", "cur", 1.0, groups=["rub"])
    assert sorted(r.rev for r in kept.collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]  # third currency dropped (N8)


def test_bins_left_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 2.9, 3.0, 7.9, 8.0, 10.0, -1.0)], "s double")
    got = [r.c for r in df.select(left_closed_bins("s", USER_BINS).alias("c")).collect()]
    assert got == ["low", "low", "mid", "mid", "high", "unknown", "unknown"]
    top = [r.c for r in df.select(left_closed_bins("s", USER_BINS, include_top=True).alias("c")).collect()]
    assert top[5] == "high"
    assert CRITIC_BINS[-1][2] == 100


def test_dedupe_keeps_smallest_id(spark):
    df = spark.createDataFrame([(2, "a", 1.0), (1, "a", 1.0), (3, "b", 2.0)], "id long, k string, v double")
    assert rows(dedupe_keep_first(df, ["k", "v"], ["id"]), "id", "k") == [(1, "a"), (3, "b")]


def test_dedupe_nulls_ties_and_copies(spark):
    data = [(None, "x", 5, "p"), (None, "x", 4, "q"), ("k", "x", None, "p"), ("k", "x", None, "q"), ("k", "x", None, "q"),
            ("k", "y", 1, "p"), ("k", "y", 1, "q"), ("k", "y", None, "a"), ("big", "z", 2 ** 62, "p"), ("big", "z", -5, "q")]
    df = spark.createDataFrame(data, "a string, b string, n long, t string")
    got = dedupe_keep_first(df, ["a", "b"], ["n"])
    r = {(x.a, x.b): x for x in got.collect()}
    assert got.count() == len(r) == 4
    assert r[(None, "x")].n == 4 and r[("k", "x")].n is None and r[("k", "y")].n == 1 and r[("big", "z")].n == -5
    by_text = dedupe_keep_first(df, ["a", "b"], ["t"])
    assert sorted(x.t for x in by_text.collect()) == ["a", "p", "p", "p"]
    assert dedupe_keep_first(df.limit(0), ["a", "b"], ["n"]).count() == 0


@pytest.mark.parametrize("build", ["venues", "tickets", "sessions", "devices"])
def test_dedupe_plans_combine_by_hash(spark, build):
    from marketlens.plans import catering, experiments, tickets
    sf = "/root/testdata/sf0.001"
    df = {"venues": lambda: catering.build_venues_clean(spark, sf),
          "tickets": lambda: dedupe_keep_first(tickets.S.ticket_orders(tickets.Tables(spark, sf)),
                                               tickets.TICKET_DUP_SUBSET, ["order_id"]),
          "sessions": lambda: experiments.first_sessions(experiments._history(spark, sf)),
          "devices": lambda: experiments.ab_device_balance(spark, sf)}[build]()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_association_bins_with_constant_seats(spark, monkeypatch):
    from marketlens.plans import catering
    v = spark.createDataFrame([("a" if i % 2 else "b", "d", i % 3 == 0, 7, "p", True, i / 10) for i in range(60)],
                              "category string, district string, chain boolean, seats long, price string, "
                              "is_24_7 boolean, rating double")
    monkeypatch.setattr(catering, "venues_clean", lambda spark, sf_dir: v)
    got = {r.attr: r for r in catering.association_table(spark, "").collect()}
    assert got["seats_bin"].cramers_v is None and got["seats_bin"].chi2 == 0 and got["chain"].n_all == 60
    assert {r.rating_bin for r in catering._binned_venues(spark, "", 10).collect()} == set(range(10))


def test_distinct_values_and_measures_in_one_pass(spark):
    df = spark.createDataFrame([("b", 1.0, 0.0), ("a", -2.0, None), (None, 3.0, 4.0)], "k string, u double, v double")
    assert [tuple(r) for r in sorted_distinct(df, ["k"]).collect()] == [("k", "a"), ("k", "b")]
    assert rows(totals_and_positive_counts(df, ["u", "v"], "m", "t", "n"), "m", "t", "n") == [("u", 2.0, 2), ("v", 4.0, 1)]


def test_users_in_both_groups(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "A")], "u long, g string")
    assert rows(users_in_several_groups(df, "g", "u"), "u") == [(1,)]


def test_conversion_counts_users_without_events(spark):
    part = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "u long, g string")
    buyers = spark.createDataFrame([(1,), (1,)], "u long")
    c = {r.g: r for r in conversion_by_group(part, buyers, "u", "g").collect()}
    assert c["A"].participants == 2 and c["A"].converted == 1 and c["B"].converted == 0


def test_event_exactly_seven_days_after_first_is_kept(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    df = spark.createDataFrame([(1, t0), (1, t0 + dt.timedelta(days=7)), (1, t0 + dt.timedelta(days=7, seconds=1))],
                               "u long, ts timestamp_ntz")
    assert events_within(df, "u", "ts", 7).count() == 2


def test_full_outer_month_on_one_side(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "p int, pub int")
    b = spark.createDataFrame([(2, 5), (3, 7)], "r int, rem int")
    j = full_outer_on(a, b, "p", "r", "m")
    assert rows(j, "m", "pub", "rem") == [(1, 10, None), (2, 20, 5), (3, None, 7)]
    assert {r.m: (r.p, r.r) for r in j.collect()} == {1: (1, None), 2: (2, 2), 3: (None, 3)}


def test_second_rate_of_a_day_is_an_error(spark):
    orders = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, None)], "id int, day string")
    once = spark.createDataFrame([("d1", 1.5)], "data string, curs double")
    assert rows(join_unique(orders, once, "day", "data", "curs"), "id", "curs") == [(1, 1.5), (2, None), (3, None)]
    twice = once.union(once)
    with pytest.raises(Exception, match="several rows"):
        join_unique(orders, twice, "day", "data", "curs").collect()


def test_zero_divisor_gives_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 2)], "a int, b int")
    assert [r.r for r in df.select(safe_div("a", "b").alias("r")).collect()] == [None, 0.5]


def test_numeric_round_half_up_on_decimal_value(spark):
    df = spark.createDataFrame([(2.675,), (1.005,), (-0.125,)], "x double")
    assert [r.r for r in df.select(numeric_round("x", 2).alias("r")).collect()] == [2.68, 1.01, -0.13]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 10)], "v double")
    h = {r.bin: r["count"] for r in histogram(df, "v", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 1, 3: 0, 4: 1}


def test_iqr_flag_per_group(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4, 100)] + [("n", 50.0)], "g string, v double")
    flagged = {r.v: r.is_outlier for r in iqr_flag(df, "v", "g").collect()}
    assert flagged[100.0] is True and flagged[2.0] is False and flagged[50.0] is False


def test_days_since_previous(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1), (1, dt.datetime(2024, 1, 4), 2),
                                (2, dt.datetime(2024, 1, 2), 3)], "u long, ts timestamp_ntz, id long")
    got = rows(days_since_previous(df, "u", "ts", "id"), "id", "days_since_prev")
    assert got == [(1, None), (2, 3), (3, None)]


def test_retention_days_without_returns_show_zero(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 4)),
                                (2, dt.datetime(2024, 1, 1))], "u long, ts timestamp_ntz")
    r = rows(retention(df, "u", "ts"), "day_offset", "retained_users")
    assert r == [(0, 2), (1, 0), (2, 0), (3, 1)]


def test_chi_square_known_table(spark):
    data = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 40
    df = spark.createDataFrame(data, "t string, a string")
    r = chi_square_association(df, "t", ["a"]).collect()[0]
    assert r.chi2 == pytest.approx(0.793651, abs=1e-5)
    assert r.cramers_v == pytest.approx(0.089087, abs=1e-5)


def test_quality_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a long, b string")
    p = {r.column: r.n_null for r in null_profile(df).collect()}
    assert p == {"a": 0, "b": 2}
    d = duplicate_counts(df).collect()[0]
    assert (d.rows, d.distinct_rows, d.duplicates) == (3, 2, 1)
    assert duplicated_rows(df, ["a"]).count() == 2


def test_date_parts(spark):
    x = spark.createDataFrame([(12, dt.datetime(2024, 1, 1))], "m int, ts timestamp_ntz").select(
        season("m").alias("s"), month_name("m").alias("n"), weekday0("ts").alias("w")).collect()[0]
    assert (x.s, x.n, x.w) == ("winter", "December", 0)


def test_midpoint_keeps_half_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), None)],
                               "a timestamp_ntz, b timestamp_ntz, m timestamp_ntz")
    got = df.select(impute_midpoint_date("a", "b", "m").alias("x")).collect()[0].x
    assert got == dt.datetime(2024, 1, 1, 12, 0)


def test_exact_quantiles_multi_pass_hot_group(spark):
    """Histogram refinement with tiny buckets/cap (many passes) equals the
    exact interpolated and discrete percentiles, with ties and a hot group."""
    import duckdb
    import numpy as np
    import pandas as pd

    from marketlens.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(7)
    n = 20000
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    v = np.round(rng.lognormal(2, 1.5, n), 2)
    v[rng.random(n) < 0.2] = 7.0
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf)
    qs = [0.0, 0.01, 0.5, 0.99, 1.0]
    con = duckdb.connect()
    con.register("t", pdf)
    for kind, fn in (("cont", "quantile_cont"), ("disc", "quantile_disc")):
        got = exact_quantiles(df, "v", qs, by="g", kind=kind, accuracy=50, cap=50).toPandas().set_index("g").sort_index()
        exp = con.execute("SELECT g, " + ", ".join(f"{fn}(v, {q})" for q in qs) + " FROM t GROUP BY g ORDER BY g") \
            .fetchdf().set_index("g")
        assert np.allclose(got.values, exp.values, rtol=1e-12, atol=1e-9), (kind, got, exp)


def test_days_since_previous_hot_key_across_ranges(spark):
    """A key spread over several ranges gets the same gaps as the plain window."""
    import random
    random.seed(3)
    base = dt.datetime(2024, 1, 1)
    data = [(1 if random.random() < 0.6 else random.randint(2, 9), base + dt.timedelta(days=random.randint(0, 400)),
             i) for i in range(3000)]
    df = spark.createDataFrame(data, "u long, ts timestamp_ntz, id long")
    a = rows(days_since_previous(df, "u", "ts", "id", skew_safe=True, partitions=16), "id", "days_since_prev")
    b = rows(days_since_previous(df, "u", "ts", "id", skew_safe=False), "id", "days_since_prev")
    assert a == b


def test_chi_square_of_observed_cells_equals_the_definition(spark):
    import numpy as np

    from marketlens.operators.experiments import chi_square_association
    r = np.random.default_rng(0)
    x = r.integers(0, 4, 500)
    y = (x + r.integers(0, 3, 500)) % 5
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), [1] * 500)), "t int, a int, one int")
    got = {k.attr: k for k in chi_square_association(df, "t", ["a", "one"]).collect()}
    o = np.zeros((4, 5))
    np.add.at(o, (x, y), 1)
    e = o.sum(1, keepdims=True) * o.sum(0) / 500
    assert abs(float(got["a"].chi2) - ((o - e) ** 2 / e).sum()) < 1e-5
    assert float(got["one"].chi2) == 0


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), (None, 1.0)], "g string, v double")
    assert [x["count"] for x in histogram(df.where("g = 'a'"), "v", 10).orderBy("bin").collect()] == [1] + [0] * 8 + [1]
    by = histogram(df, "v", 4, by="g").collect()
    assert len(by) == 8 and sum(x["count"] for x in by if x["g"] is None) == 1


def test_year_matrix_has_every_year_of_the_data(spark):
    from marketlens.plans.startups import _year_matrix
    df = spark.createDataFrame([("a", 1980, 1.0), ("a", 2031, 2.0), ("a", 2031, 4.0), ("b", 1999, 3.0), (None, 1700, 1.0), ("c", None, 9.0)],
                               "market string, year long, funding_total_usd double")
    wide = _year_matrix(df)
    assert wide.columns == ["market", "1980", "1999", "2031"]
    assert sorted(map(tuple, wide.collect())) == [("a", 1.0, 0.0, 6.0), ("b", 0.0, 3.0, 0.0), ("c", 0.0, 0.0, 0.0)]
    assert _year_matrix(df.limit(0)).columns == ["market"]
