"""Checkpoint folder handling and shared tables."""

import os

from marketlens import session


def test_checkpoint_dir_is_read_from_the_session(spark):
    path = session.ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == path
    assert session.ensure_checkpoint_dir(spark) == path  # never replaced once set


def test_shared_table_written_once_under_checkpoint_dir(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumnRenamed("id", "x")

    a = session.shared_table(spark, "unit-test-table", build)
    b = session.shared_table(spark, "unit-test-table", build)
    assert len(calls) == 1 and a.count() == b.count() == 10
    files = a.inputFiles()
    assert files and all(session.ensure_checkpoint_dir(spark).rstrip("/") in f for f in files)


def test_write_through_cuts_lineage(spark):
    df = session.write_through(spark.range(5).selectExpr("id * 2 AS y"), "unit")
    assert sorted(r.y for r in df.collect()) == [0, 2, 4, 6, 8]
    assert "Scan parquet" in df._jdf.queryExecution().executedPlan().toString() or \
        "FileScan" in df._jdf.queryExecution().executedPlan().toString()
    assert os.path.basename(df.inputFiles()[0]).startswith("part-")


def test_shared_table_follows_its_inputs(spark, tmp_path):
    """A changed input gives new results in one session; an unchanged one is not built again."""
    path, calls = f"{tmp_path}/in", []
    spark.range(5).coalesce(1).write.parquet(path)

    def build():
        calls.append(1)
        return spark.read.parquet(path).selectExpr("id * 2 AS y")

    def read():
        return sorted(r.y for r in session.shared_table(spark, "unit-inputs", build, [path]).collect())

    assert read() == read() == [0, 2, 4, 6, 8] and len(calls) == 1
    spark.range(5, 7).coalesce(1).write.mode("append").parquet(path)
    assert read() == [0, 2, 4, 6, 8, 10, 12] and len(calls) == 2


def test_metrics_observed_while_a_table_is_written(spark):
    from pyspark.sql import functions as F
    calls = []

    def build():
        calls.append(1)
        return spark.range(8), [F.count(F.lit(1)).alias("n"), F.max("id").alias("top")]

    row = session.shared_metrics(spark, "unit-metrics", build).first()
    assert (row["n"], row["top"]) == (8, 7)
    assert session.shared_table(spark, "unit-metrics", build).count() == 8 and len(calls) == 1


def test_scratch_of_an_application_is_removed(spark):
    import glob
    df = session.write_through(spark.range(3), "unit-scratch")
    folder = os.path.dirname(os.path.dirname(df.inputFiles()[0].removeprefix("file:").replace("///", "/")))
    own = f"{folder}-unit-test-copy"  # not the folder the other tests read from
    spark.range(2).write.parquet(f"file://{own}/t")
    assert glob.glob(f"{own}/t/*.parquet")
    session._remove(spark, f"file://{own}")
    assert not os.path.exists(own) and os.path.exists(folder)
