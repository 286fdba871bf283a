"""Structured Streaming form of the daily activity metrics (M1, M3).

Events arrive as parquet files. Each user is counted once per day by
``dropDuplicatesWithinWatermark`` on (user, day) - the state for a day is
dropped once the watermark passes it - and the deduplicated stream is
counted per one-day event-time window; revenue of purchases is summed per
window in the same pass over the original events. Output mode is append:
a day is emitted once it can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, path: str, schema=None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream (the schema is declared or taken from the data).
    ``path`` is a directory or a glob such as ``.../events*.parquet``."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def daily_active_users(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """M1 on a stream: distinct users per event-time day."""
    ev = events.select("user_id", F.col("ts").cast("timestamp").alias("event_time")) \
        .withColumn("day", F.to_date("event_time")).withWatermark("event_time", lateness)
    once = ev.dropDuplicatesWithinWatermark(["user_id", "day"])
    return once.groupBy(F.window("event_time", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("dau")) \
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "dau")


def daily_revenue(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """M3 on a stream: orders and revenue of purchases per event-time day."""
    ev = events.filter(F.col("event_type") == "purchase").select(
        F.col("ts").cast("timestamp").alias("event_time"), "value").withWatermark("event_time", lateness)
    return ev.groupBy(F.window("event_time", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("value").cast("decimal(18,2)")).alias("revenue")) \
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "orders", F.col("revenue").cast("double"))


def run_to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over all available input (``availableNow``) into Parquet
    files and return them as a table. Output and progress lie under the shared
    checkpoint folder (or ``path``), so a restarted query resumes and the
    driver holds no rows."""
    base = path or f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/streams/{name}"
    q = (stream.writeStream.outputMode("append").format("parquet").queryName(name)
         .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")
