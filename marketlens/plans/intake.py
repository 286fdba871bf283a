"""Intake of text files and catalog tables (S1-S5, P12): the given tables are
written in the formats of the sources under the checkpoint folder and read
back through ``sources.files``; what is reported comes from the files read."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import numeric_round
from ..operators.clean import normalize_headers, replace_text, to_number, to_timestamp_text
from ..session import ensure_checkpoint_dir, write_through
from ..sources import standins as S
from ..sources.files import read_csv, read_dirty_csv, read_table, row_count
from ..sources.infer import read_csv_inferred, read_csv_text, type_counts
from ..sources.tables import Tables
from ..sources.zipped import read_zip_csv


def _as_csv(spark: SparkSession, df: DataFrame, **options) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marketlens-tmp/{spark.sparkContext.applicationId}" \
           f"/csv-{uuid.uuid4().hex}"
    df.write.options(header=True, **options).csv(path)
    return path


def csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header CSV with a declared schema: orders and money per status."""
    src = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    df = read_csv(spark, _as_csv(spark, src), "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return df.groupBy("o_orderstatus").agg(
        F.count("o_orderkey").alias("orders"),
        numeric_round(F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double"), 2).alias("money"))


def csv_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a header CSV and of the table it was written from."""
    src = Tables(spark, sf_dir).customer.select("c_custkey", "c_name")
    back = read_csv(spark, _as_csv(spark, src), "c_custkey bigint, c_name string")
    sides = [row_count(d).withColumn("source", F.lit(n)) for n, d in (("table", src), ("csv", back))]
    return sides[0].unionByName(sides[1])


def csv_dirty_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``;`` separated text of mixed types: amounts that are numbers,
    amounts that are not, and their sum, per status."""
    src = S.startup_investments_raw(Tables(spark, sf_dir)).select("name", "status", "funding_total_usd")
    df = normalize_headers(read_dirty_csv(spark, _as_csv(spark, src, sep=";"), src.columns))
    usd = to_number(replace_text("funding_total_usd", ",", ""))
    return df.groupBy("status").agg(
        F.count(F.lit(1)).alias("companies"), F.count(usd).alias("with_amount"),
        F.count_if(F.col("funding_total_usd").isNotNull() & usd.isNull()).alias("bad_amount"),
        F.sum(usd).alias("money"))


def csv_gzip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: compressed CSV whose timestamp column is parsed while reading."""
    src = Tables(spark, sf_dir).events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_dt"), "event_type")
    df = read_csv(spark, _as_csv(spark, src, compression="gzip"), "event_dt timestamp, event_type string",
                  timestamp_format="yyyy-MM-dd HH:mm:ss")
    return df.groupBy(F.date_format("event_dt", "yyyy-MM-dd").alias("day"), F.hour("event_dt").cast("bigint")
                      .alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def zip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: zip archives, one per part of the events, each with two CSV members
    whose timestamp column is parsed while reading: events and first event per
    kind of member and hour."""
    src = Tables(spark, sf_dir).events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_dt"), "event_type", "user_id")
    rows = read_zip_csv(spark, _as_zips(spark, src), "event_dt timestamp, event_type string, user_id bigint",
                        timestamp_format="yyyy-MM-dd HH:mm:ss")
    return rows.groupBy(F.element_at(F.split("member", "/"), -1).alias("member"), F.hour("event_dt").cast("bigint").alias("hour")).agg(
        F.count("event_dt").alias("events"), F.count_distinct("user_id").alias("users"),
        F.date_format(F.min("event_dt"), "yyyy-MM-dd HH:mm:ss").alias("first_event"))


def _as_zips(spark: SparkSession, df: DataFrame) -> list[str]:
    """The rows as zip archives under the checkpoint folder, written by the
    tasks: members ``even.csv`` and ``odd.csv`` by user."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marketlens-tmp/{spark.sparkContext.applicationId}/zip-{uuid.uuid4().hex}"

    def write(batches):
        import io
        import zipfile

        from pyarrow import csv, fs
        from pyarrow import compute as pc
        system, place = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))
        system.create_dir(place, recursive=True)
        for b in batches:
            name = f"{uuid.uuid4().hex}.zip"
            odd = pc.equal(pc.bit_wise_and(b.column("user_id"), 1), 1)
            with system.open_output_stream(f"{place}/{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for member, keep in (("even", pc.invert(odd)), ("odd", odd)):
                    text = io.BytesIO()
                    csv.write_csv(b.filter(keep), text)
                    z.writestr(f"{member}.csv", text.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    return [r["path"] for r in write_through(df.mapInArrow(write, "path string"), "zips").collect()]


def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of a header CSV of text, found in one scan: per column its
    type and the cells that it does not read, strictly and with 5 % tolerated."""
    o, k = Tables(spark, sf_dir).orders, F.col("o_orderkey")
    src = o.select(
        k, "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("moment"),
        F.when(k % 50 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(k % 3 == 0, F.lit(None)).otherwise((k % 2 == 0).cast("string")).alias("even"))
    path = _as_csv(spark, src)
    counts = type_counts(read_csv_text(spark, path))  # one scan for both tolerances
    strict, loose = (read_csv_inferred(spark, path, tolerate=x, counts=counts)[1] for x in (0.0, 0.05))
    return strict.join(loose.select("position", F.col("type").alias("type_loose"), F.col("n_bad").alias("n_bad_loose")), "position").select(
        "position", "column", "type", "n_rows", "n_null", "n_bad", "type_loose", "n_bad_loose")


def csv_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to timestamp without a format (bad text is NULL): orders per
    month, and those whose text is no date."""
    o = Tables(spark, sf_dir).orders
    text = F.when(F.col("o_orderkey") % 50 == 0, "n/a").when(
        F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    df = read_csv(spark, _as_csv(spark, o.select("o_orderkey", text.alias("created"))),
                  "o_orderkey bigint, created string")
    return df.groupBy(F.date_format(to_timestamp_text("created"), "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"))


def catalog_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema-qualified table of the catalog: orders per priority."""
    name = f"marketlens_orders_{uuid.uuid4().hex}"
    Tables(spark, sf_dir).orders.createOrReplaceGlobalTempView(name)
    df = read_table(spark, f"global_temp.{name}")
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last_order"))
