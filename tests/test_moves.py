"""Rows that need not move stay where they are: rare repeats, gaps, limits, types, group thresholds."""

import pytest
from pyspark.sql import functions as F

from marketlens import session
from marketlens.operators import clean, outliers, quantiles
from marketlens.operators.windows import days_since_previous
from marketlens.sources import infer


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rare_repeats_alone_are_compared(spark, monkeypatch):
    df = spark.range(0, 2000, 1, 4).select(
        F.col("id"), F.concat(F.lit("a wide key of text "), (F.col("id") % 1990).cast("string")).alias("k"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 1990).alias("v"))
    compared, real = [], clean.drop_repeats
    monkeypatch.setattr(clean, "drop_repeats", lambda d, cols, pick: real(d, cols, lambda r: compared.append(r.count()) or pick(r)))
    got = clean.dedupe_keep_first(df, ["k", "v"], ["id"], rare=True)
    assert rows(got) == rows(clean.dedupe_keep_first(df, ["k", "v"], ["id"]))
    assert len(compared) == 1 and 0 < compared[0] <= 20


def test_gaps_of_keys_that_are_not_heavy_move_once(spark, monkeypatch):
    df = spark.range(0, 6000, 1, 4).select(F.col("id"), (F.col("id") % 2000).alias("u"),
                                           F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10 ** 8))).alias("ts"))
    monkeypatch.setattr(session, "write_through", None)  # no row is written
    got = days_since_previous(df, "u", "ts", "id")
    assert plan(got).partition("== Physical Plan ==")[2].count("Exchange ") == 1
    assert rows(got) == rows(days_since_previous(df, "u", "ts", "id", skew_safe=False))


def test_gaps_with_heavy_and_null_keys(spark):
    user = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 900 + 10)
    df = spark.range(0, 9000, 1, 4).select(F.col("id"), user.alias("u"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10 ** 8))).alias("ts"))
    want = rows(days_since_previous(df, "u", "ts", "id", skew_safe=False))
    one = df.select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]
    for hot in (None, {one: 0.3}, {}):
        assert rows(days_since_previous(df, "u", "ts", "id", partitions=5, hot=hot)) == want


def test_limits_take_the_bounds_of_each_column_alone(spark, monkeypatch):
    df = spark.range(1, 501).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 10).alias("b"), F.lit(None).cast("double").alias("c"))
    bounds = [outliers.Bound("b", 0.9, "disc"), outliers.Bound("a", 0.99), outliers.Bound("a", 0.01, "cont", ">"), outliers.Bound("c", 0.5)]
    asked, real = [], outliers.exact_quantiles
    monkeypatch.setattr(outliers, "exact_quantiles", lambda d, v, qs, **k: asked.append((v, len(qs))) or real(d, v, qs, **k))
    got = outliers.percentile_limits(df, bounds).collect()
    assert [tuple(r) for r in got] == [(8.0, pytest.approx(495.01), pytest.approx(5.99), None)]
    assert sorted(asked) == [("a", 2), ("b", 1), ("c", 1)]
    none = outliers.percentile_limits(df.limit(0), bounds).collect()
    assert [tuple(r) for r in none] == [(None,) * 4]


def test_cells_are_placed_without_a_lambda(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)], "__v double")
    cells = quantiles._cells(df, [], [(F.lit(2.0), F.lit(5.0), F.lit(True))], [])
    assert "lambda" not in plan(cells)
    assert [(r["side"], r["w"], r["c"], r["before"]) for r in cells.orderBy("side", "w").collect()] == [
        (0, None, 2, 0), (1, None, 1, 2), (2, 3.0, 1, 3), (2, 4.0, 1, 4), (3, None, 1, 5), (4, None, 3, 6)]


def test_rows_do_not_meet_by_group_of_a_threshold(spark, tmp_path):
    spark.range(0, 3000, 1, 4).select((F.col("id") % 7).alias("y"), F.col("id").alias("n")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = outliers.keep_groups_over_threshold(df, "y", "n", 642_500)
    assert "SortMergeJoin" not in plan(got) and "BroadcastHashJoin" in plan(got)
    kept = {y for y in range(7) if sum(range(y, 3000, 7)) >= 642_500}
    assert 0 < len(kept) < 7 and {r["y"] for r in got.collect()} == kept


def test_types_of_two_tolerances_come_from_one_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,\nz,true\n")
    text = infer.read_csv_text(spark, str(tmp_path / "t.csv"))
    counts = infer.type_counts(text)
    for tolerate, want in ((0.0, [("string", 0), ("string", 0)]), (0.5, [("bigint", 1), ("boolean", 1)])):
        report = infer.read_csv_inferred(spark, str(tmp_path / "t.csv"), tolerate=tolerate, counts=counts)[1]
        assert "csv" not in plan(report)
        assert [(r["type"], r["n_bad"]) for r in report.orderBy("position").collect()] == want
        assert rows(report) == rows(infer.infer_types(text, tolerate))
