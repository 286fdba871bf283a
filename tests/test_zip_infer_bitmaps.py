"""Zip members as partitions, inferred types, users from bitmaps."""

import zipfile

import pytest
from pyspark.sql import functions as F

from marketlens.operators import bitmaps, metrics
from marketlens.operators.experiments import overlap_summary
from marketlens.sources.infer import infer_types, read_csv_inferred
from marketlens.sources.zipped import read_zip_csv, read_zip_lines


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zip") / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", "id,when,note\n1,2024-01-05 10:00:00,\"a, b\"\n2,bad,x\n\n3,2024-01-06 00:00:01,\n")
        z.writestr("dir/two.csv", "id,when,note\r\n9,2024-02-01 00:00:00,caf\u00e9\u2028x\r\n")
        z.writestr("readme.txt", "no table")
        z.writestr("empty.csv", "")
        z.writestr("big.csv", "id,when,note\n" + "".join(f"{i},,n\n" for i in range(25000)))
    return path


def test_zip_members_are_partitions(spark, archive):
    lines = read_zip_lines(spark, archive)
    assert lines.rdd.getNumPartitions() == 5
    per = lines.select("member", F.spark_partition_id().alias("task")).groupBy("member", "task").count().collect()
    assert {r["member"]: r["count"] for r in per} == {"one.csv": 5, "dir/two.csv": 2, "readme.txt": 1, "big.csv": 25001}
    assert len({r["task"] for r in per}) == len(per) == 4  # a task per member


def test_zip_csv(spark, archive):
    df = read_zip_csv(spark, archive, "id int, when timestamp, note string", timestamp_format="yyyy-MM-dd HH:mm:ss")
    got = sorted((r["member"], r["id"], str(r["when"]), r["note"]) for r in df.where("member != 'big.csv'").collect())
    assert got == [("dir/two.csv", 9, "2024-02-01 00:00:00", "caf\u00e9\u2028x"), ("one.csv", 1, "2024-01-05 10:00:00", "a, b"),
                   ("one.csv", 2, "None", "x"), ("one.csv", 3, "2024-01-06 00:00:01", None)]
    assert df.where("member = 'big.csv'").agg(F.sum("id")).first()[0] == sum(range(25000))


def test_archive_without_members(spark, tmp_path):
    path = str(tmp_path / "none.zip")
    with zipfile.ZipFile(path, "w"):
        pass
    assert read_zip_lines(spark, path).count() == 0


def test_inferred_types(spark):
    rows = [("1", "1.5", "true", "2024-01-01", "2024-01-01 10:00", "x", "", "99999999999999999999", "2024-02-30", "NaN", "7"),
            ("-2", "3", "FALSE", "2024-12-31", "2024-01-02", "1", "  ", "1", "2024-01-01", "1", "n/a"),
            (None, "1e3", None, None, None, "2", None, "2", None, "2", "8")]
    names = ["int", "dbl", "flag", "day", "moment", "text", "void", "wide", "notday", "nan", "mixed.x"]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))
    got = {r["column"]: (r["type"], r["n_null"], r["n_bad"]) for r in infer_types(df).collect()}
    assert got == {"int": ("bigint", 1, 0), "dbl": ("double", 0, 0), "flag": ("boolean", 1, 0), "day": ("date", 1, 0),
                   "moment": ("timestamp", 1, 0), "text": ("string", 0, 0), "void": ("string", 3, 0), "wide": ("double", 0, 0),
                   "notday": ("string", 1, 0), "nan": ("string", 0, 0), "mixed.x": ("string", 0, 0)}
    loose = {r["column"]: (r["type"], r["n_bad"]) for r in infer_types(df, 0.4).collect()}
    assert loose["mixed.x"] == ("bigint", 1) and loose["wide"] == ("bigint", 1)
    none = infer_types(df.limit(0)).collect()
    assert {r["type"] for r in none} == {"string"} and {r["n_rows"] for r in none} == {0}


def test_inferred_frame(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,x,2024-01-01\n2,,oops\n3,y,2024-01-03\n")
    df, report = read_csv_inferred(spark, str(tmp_path / "t.csv"), tolerate=0.4)
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "date")]
    assert [(r["a"], r["b"], str(r["c"])) for r in df.orderBy("a").collect()] == [(1, "x", "2024-01-01"), (2, None, "None"), (3, "y", "2024-01-03")]
    assert [r["n_bad"] for r in report.orderBy("position").collect()] == [0, 0, 1]


def events(spark):
    """Many users over more than two bitmap buckets, NULL users, a hot user, days without users."""
    day = F.element_at(F.array(*[F.lit(d) for d in ("2024-01-30", "2024-02-01", "2024-02-02", "2024-02-07")]), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int"))
    user = F.when(F.col("id") % 10 == 0, F.lit(-5)).when(F.col("id") % 997 != 0, F.col("id") % 70001 * 3)
    return spark.range(0, 90000, 1, 4).select(user.alias("u"), F.to_timestamp(day).alias("ts"),
                                              F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bitmaps_equal_distinct_counts(spark):
    ev = events(spark)
    bits = bitmaps.day_bitmaps(ev, "u", "ts")
    assert bits.select("bucket").distinct().count() == 3
    assert rows(bitmaps.dau_of(bits)) == rows(metrics.dau(ev, "u", "ts"))
    known = ev.where("u is not null")
    for cohort in (None, "month"):
        assert rows(bitmaps.retention_of(bits, cohort)) == rows(metrics.retention(known, "u", "ts", cohort))
    by = bitmaps.day_bitmaps(ev, "u", "ts", ["g"])
    assert rows(bitmaps.overlap_of(by, "g", "a", "b")) == rows(overlap_summary(known, "g", "u", "a", "b"))
    assert rows(bitmaps.users_of(by, ["g"])) == rows(known.groupBy("g").agg(F.count_distinct("u")))


def test_user_numbers_are_exact(spark):
    got = bitmaps.number_users(events(spark), "u").orderBy("u").collect()
    assert [r["number"] for r in got] == list(range(len(got)))
    none = bitmaps.day_bitmaps(events(spark).limit(0), "u", "ts")
    assert none.count() == 0 and bitmaps.retention_of(none).count() == 0
