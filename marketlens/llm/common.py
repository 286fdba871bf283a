"""Helpers shared by the operators: row identity, Arrow row maps, scratch tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import write_through

# Column names used inside the operators; the prefix keeps them apart from
# whatever extra columns the caller's tables carry.
FILE, ROW = "__llm_file", "__llm_row"
SLICE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row_id(df: DataFrame) -> DataFrame:
    """Add (FILE, ROW): the same pair for the same row in every scan, so that
    verdicts about rows can be joined back even where ids are null or repeat.
    A frame that is not a plain file scan is written once first; one that has
    the columns already is returned as it is."""
    if FILE in df.columns:
        return df
    try:
        return df.select("*", F.xxhash64(F.col("_metadata.file_path")).alias(FILE),
                         F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:
        saved = write_through(df, "rows")
        return saved.select("*", F.xxhash64(F.col("_metadata.file_path")).alias(FILE),
                            F.col("_metadata.row_index").alias(ROW))


_KEPT: list = []
_LAST = [""]


def kept(size: int):
    """``lru_cache`` of what an operator keeps in a Python worker from task to
    task: vocabularies and remembered words."""
    def keep(make):
        cached = lru_cache(maxsize=size)(make)
        _KEPT.append(cached)
        return cached
    return keep


def begin(operator: str) -> None:
    """At the start of a task: a worker that Spark reuses drops what another
    operator kept in it, so that the stages of a pipeline do not add up."""
    if _LAST[0] not in ("", operator):
        for cached in _KEPT:
            cached.cache_clear()
        gc.collect()
    _LAST[0] = operator


def map_texts(df: DataFrame, keep: list[str], compute: Callable[[list], dict], schema) -> DataFrame:
    """Columns ``keep`` unchanged plus the columns ``compute`` derives from the
    texts of each Arrow batch (a column named ``text`` of ``df``); one output
    row per input row, no shuffle. Ids never pass through pandas, so null or
    large 64-bit ids stay exact. A worker holds the results of ``SLICE`` rows
    at a time."""

    operator = compute.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                got = compute(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + list(got.values()),
                                                 names=keep + list(got))

    return df.mapInArrow(run, schema)
