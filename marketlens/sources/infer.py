"""Inferred column types of delimited text (S1), with the cells that do not fit.

One scan tests every cell against the types from narrow to wide and counts, per
column, the cells that each type reads. The narrowest type that reads all of
them is the column's; with a tolerated share of bad cells, the narrowest that
reads all but those. The counts are one aggregated row, so the result does not
depend on which rows come first, and nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_through

# Narrow to wide. A cell of one type is read by the wider ones that join it
# with another: long and double by double, date and timestamp by timestamp.
TYPES = ("boolean", "bigint", "double", "date", "timestamp")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_TIMESTAMP = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"


def _reads(cell: Column) -> dict[str, Column]:
    """Whether each type reads the cell."""
    return {"boolean": F.lower(cell).isin("true", "false"),
            "bigint": cell.rlike(r"^[+-]?\d+$") & cell.try_cast("bigint").isNotNull(),
            "double": cell.rlike(_NUMBER) & cell.try_cast("double").isNotNull(),
            "date": cell.rlike(_DATE) & cell.try_cast("date").isNotNull(),
            "timestamp": cell.rlike(_TIMESTAMP) & cell.try_cast("timestamp").isNotNull()}


def type_counts(df: DataFrame) -> DataFrame:
    """The scan: one row per text column (position, column, n_rows, n, and the
    cells read as each type); n are the cells that are not empty. Written, so
    that types of any tolerance are read off it."""
    cells = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns}
    aggs = []
    for i, (c, x) in enumerate(cells.items()):
        aggs += [F.count(x).alias(f"{i}_n"), *[F.count_if(ok).alias(f"{i}_{t}") for t, ok in _reads(x).items()]]
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    each = [F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column"), F.col(f"{i}_n").alias("n"),
                     *[F.col(f"{i}_{t}").alias(f"n_{t}") for t in TYPES]) for i, c in enumerate(df.columns)]
    return write_through(row.select("n_rows", F.inline(F.array(*each))), "type-counts")


def infer_types(df: DataFrame, tolerate: float = 0.0, counts: DataFrame | None = None) -> DataFrame:
    """One row per text column: (position, column, type, n_rows, n_null, n_bad,
    and the cells read as each type). Empty cells count as NULL. ``type`` is
    the narrowest type that reads all cells but at most the share ``tolerate``
    of them, else string; a column without a cell is a string. ``n_bad`` are
    the cells its type does not read. ``counts`` are the ``type_counts`` of
    ``df`` where they exist already."""
    rows = type_counts(df) if counts is None else counts
    kind = F.when(F.col("n") == 0, "string")
    bad = F.when(F.col("n") == 0, 0)
    for t in TYPES:
        fits = F.col("n") - F.col(f"n_{t}") <= F.lit(tolerate) * F.col("n")
        kind, bad = kind.when(fits, t), bad.when(fits, F.col("n") - F.col(f"n_{t}"))
    return rows.select("position", "column", kind.otherwise("string").alias("type"), "n_rows", (F.col("n_rows") - F.col("n")).alias("n_null"),
                       bad.otherwise(0).cast("bigint").alias("n_bad"), *[f"n_{t}" for t in TYPES])


def read_csv_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A header CSV with all columns as text. The header gives the names."""
    header = spark.read.option("header", "true").option("sep", sep).option("inferSchema", "false").csv(path)
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header.columns])).option(
        "header", "true").option("sep", sep).csv(path)


def read_csv_inferred(spark: SparkSession, path: str, sep: str = ",", tolerate: float = 0.0,
                      counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(frame, report): a header CSV with the types of ``infer_types``; cells
    that their type does not read are NULL. Only the report, one row per
    column, comes to the driver. The file is scanned for ``counts`` unless they
    are passed."""
    text = read_csv_text(spark, path, sep)
    report = infer_types(text, tolerate, counts)
    cols = []
    for r in report.orderBy("position").collect():
        cell = F.nullif(F.trim(F.col(f"`{r['column']}`")), F.lit(""))
        ok = _reads(cell).get(r["type"])
        cols.append((F.col(f"`{r['column']}`") if ok is None else F.when(ok, cell.try_cast(r["type"]))).alias(r["column"]))
    return text.select(*cols), report
