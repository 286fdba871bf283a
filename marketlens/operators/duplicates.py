"""Duplicates without shuffling whole rows (Q6-Q10).

Every row has a digest of 64 bits. A first pass counts the digests
alone, combined map-side, and turns those that occur more than once into a
bitmap of at most ``BITS`` bits. A row whose bit is not set is unique: it stays
where it is. Only the others move, and are compared in full. The digest decides
which rows are compared, never which are equal, so a collision costs time and
not rows.

The bitmap is broadcast; its size does not grow with the data beyond ``BITS``
bits. Beyond some millions of repeated digests more and more unique rows meet a
set bit and are shuffled like the repeated ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 26  # of the bitmap: at most 2 ** 20 words of 64 bits
DIGEST_BYTES = 16  # a digest and its count in a shuffle: rows no wider are shuffled themselves


def _width(df: DataFrame, cols: Sequence[str]) -> int:
    """Bytes of ``cols`` if all have a fixed width, else more than a digest."""
    size = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4,
            T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}
    return sum(size.get(type(df.schema[c].dataType), DIGEST_BYTES + 1) for c in cols)


def _digest(cols: Sequence[str]) -> tuple[Column, ...]:
    named = [F.col(c) for c in cols]
    # a hash passes over NULLs: where they are is hashed too
    return (F.xxhash64(*[c.isNull() for c in named], *named),)


def _bit(digest: Column) -> tuple[Column, Column]:
    """Word and bit of a digest in the bitmap."""
    at = F.pmod(digest, F.lit(BITS))
    return F.floor(at / 64).alias("__word"), (at % 64).cast("int").alias("__bit")


def repeated_bitmap(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(__word, __bits) of the digests of ``cols`` that more than one row has:
    words that hold a bit, at most ``BITS / 64``."""
    again = df.select(_digest(cols)[0].alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return again.select(*_bit(F.col("d"))).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))


def marked_repeats(df: DataFrame, cols: Sequence[str], out: str = "maybe_repeated") -> DataFrame:
    """``df`` with a boolean ``out`` that is true for every row whose ``cols``
    another row has too, and false for nearly all others. No row moves."""
    word, bit = _bit(_digest(cols)[0])
    keyed = df.withColumn("__word", word).withColumn("__bit", bit)
    hit = F.coalesce(F.expr("getbit(__bits, __bit)") == 1, F.lit(False))
    return keyed.join(F.broadcast(repeated_bitmap(df, cols)), "__word", "left").select(*df.columns, hit.alias(out))


def drop_repeats(df: DataFrame, cols: Sequence[str] | None = None, pick=None) -> DataFrame:
    """Rows without duplicates in ``cols`` (default all columns). ``pick``
    takes the rows that may repeat and returns those that stay; by default
    equal rows become one. A row no wider than its digest is not digested.
    ``df`` is read three times, the last two times only where it is kept or
    compared: pass a scan or a written table."""
    cols = list(cols or df.columns)
    pick = pick or (lambda rows: rows.distinct())
    if _width(df, cols) <= DIGEST_BYTES:
        return pick(df)
    marked = marked_repeats(df, cols, "__again")
    unique = marked.where(~F.col("__again")).drop("__again")
    return unique.unionByName(pick(marked.where("__again").drop("__again")))


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row (rows, distinct_rows): exact, equal rows compared in full."""
    cols = list(cols or df.columns)
    src = df.select(*cols)
    if _width(df, cols) <= DIGEST_BYTES:
        per = src.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
        return per.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
    marked = marked_repeats(src, cols, "__again")
    # the unique rows are counted where they are: without their columns they are one group
    key = [F.when(F.col("__again"), F.col(c)).alias(c) for c in cols]
    per = marked.groupBy(*key, "__again").agg(F.count(F.lit(1)).alias("__n"))
    return per.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
                   F.coalesce(F.sum(F.when(F.col("__again"), 1).otherwise(F.col("__n"))), F.lit(0)).alias("distinct_rows"))
