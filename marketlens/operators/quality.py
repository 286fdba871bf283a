"""Data-quality profiles and audits (Q1-Q11).

Each profile is a single aggregate over the table (one pass, partial
aggregation), unpivoted to one row per column where that reads better.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .duplicates import distinct_rows


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = False) -> DataFrame:
    """Q1/Q3/Q4: NULL count and percent per column (``isna().sum()``,
    ``isna().mean()``); ``only_missing`` keeps columns that have NULLs."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "column", "n_null")
    res = long.select("column", "n_null", (F.col("n_null") * 100.0 / F.col("__n")).alias("null_pct"))
    return res.filter(F.col("n_null") > 0) if only_missing else res


def null_totals(df: DataFrame) -> DataFrame:
    """Q2: total NULL cells and rows with at least one NULL."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    cells = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.sum(cells).alias("null_cells"), F.count_if(any_null).alias("rows_with_null"),
                  F.count(F.lit(1)).alias("rows"))


def marker_counts(df: DataFrame, cols: Sequence[str], marker: str) -> DataFrame:
    """Q5: occurrences of a marker value per column."""
    wide = df.agg(*[F.count_if(F.col(c) == F.lit(marker)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "n_marker").withColumn("marker", F.lit(marker))


def duplicate_counts(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Q6/Q8: rows, distinct rows (or distinct keys) and the duplicate count.
    Only rows whose digest occurs twice are shuffled and compared."""
    return distinct_rows(df, keys).select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"))


def duplicated_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q7: every copy of rows whose key repeats (``duplicated(keep=False)``),
    as repeated keys joined back (a semi join, split by AQE if one key is hot)
    rather than a count window over the key."""
    reps = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > 1).select(*keys)
    return df.join(reps, on=list(keys), how="left_semi")
