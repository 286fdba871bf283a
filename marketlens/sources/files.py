"""File and database sources of the analyses.

The analyses read CSV files with a header, one with a ``;`` separator and
dirty mixed-type columns, one compressed file with a timestamp column, and
schema-qualified database tables. Schemas are declared, never inferred: an
inference pass is a full extra scan of the input at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",",
             timestamp_format: str | None = None) -> DataFrame:
    """Header CSV with a declared schema. gzip/bzip2 files are read
    transparently by the Hadoop codecs; a zip archive must be unpacked first.
    Malformed values become NULL (PERMISSIVE), like ``errors='coerce'``."""
    reader = (spark.read.schema(schema).option("header", "true").option("sep", sep)
              .option("mode", "PERMISSIVE"))
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    return reader.csv(path)


def read_dirty_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Every column as STRING (``low_memory=False`` mixed types); typed
    later with ``try_cast`` so bad cells become NULL instead of failing."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return read_csv(spark, path, schema, sep=sep)


def read_table(spark: SparkSession, qualified_name: str, jdbc_url: str | None = None,
               properties: dict | None = None, num_partitions: int | None = None,
               partition_column: str | None = None, lower: int | None = None,
               upper: int | None = None) -> DataFrame:
    """``schema.table`` from the catalog, or over JDBC. A partitioned JDBC
    read splits the scan over ``num_partitions`` tasks by a numeric column."""
    if jdbc_url is None:
        return spark.table(qualified_name)
    props = dict(properties or {})
    if num_partitions and partition_column:
        return spark.read.jdbc(jdbc_url, qualified_name, column=partition_column,
                               lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(jdbc_url, qualified_name, properties=props)


def row_count(df: DataFrame) -> DataFrame:
    """S5 as a one-row frame (``len(df)``), so it composes with other queries."""
    from pyspark.sql import functions as F
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
