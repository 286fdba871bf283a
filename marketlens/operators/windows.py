"""Window operators.

Windows partitioned by a low-cardinality key send a whole key to one task,
so a key holding a third of all rows would make one straggler. Where the
same result is an aggregate joined back, that form is used: the aggregate is
combined map-side and the join is split by AQE's skew handling. Windows
without a partition (shares of all rows, ranks of groups) only ever run on
already aggregated rows, whose count is the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import heavy_keys


def count_over_partition_distinct(df: DataFrame, part: str, counted: str, out: str) -> DataFrame:
    """``SELECT DISTINCT k, COUNT(x) OVER (PARTITION BY k)``: one count per
    key, combined map-side, instead of a window over the raw rows that would
    put a whole key in one task."""
    return df.groupBy(part).agg(F.count(counted).alias(out))


def days_since_previous(df: DataFrame, key: str, ts: str, tie: str | Sequence[str],
                        out: str = "days_since_prev", skew_safe: bool = True,
                        partitions: int | None = None, hot: dict[int, float] | None = None) -> DataFrame:
    """Whole days since the same key's previous row (NULL on the first).

    Rows are ordered by (ts, *tie) inside a key; ``tie`` must make the order
    total so the result does not depend on row arrival order.

    ``lag`` over ``partitionBy(key)`` puts every row of a key in one task, so
    a user with a third of all orders would be one straggler. The skew-safe
    form takes it for the keys that are not heavy alone: their rows move once.
    The rows of the heavy keys (``hot``, by default ``heavy_keys`` of ``df``;
    pass those of a scan where ``df`` is costly) are split by ranges. ``df`` is
    read again for each of the two parts if there are heavy keys.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    order = [ts, *ties]

    def whole(rows: DataFrame) -> DataFrame:
        prev = F.lag(ts).over(Window.partitionBy(key).orderBy(*order))
        return rows.withColumn(out, F.datediff(F.to_date(ts), F.to_date(prev)).cast("bigint"))

    if skew_safe and hot is None:
        hot = heavy_keys(df, [key])
    if not (skew_safe and hot):
        return whole(df)
    heavy = F.xxhash64(F.col(key)).isin(list(hot))
    return whole(df.filter(~heavy)).unionByName(_lag_over_ranges(df.filter(heavy), key, ts, order, out, partitions))


def _lag_over_ranges(df: DataFrame, key: str, ts: str, order: list[str], out: str, partitions: int | None) -> DataFrame:
    """``days_since_previous`` of keys with many rows each: the rows are
    range-partitioned on (key, *order) - the sampled bounds split a hot key into
    several balanced ranges - the range number is frozen by writing them once,
    ``lag`` is taken inside (range, key), and the first row of a key in each
    range is repaired with the last row of the previous range (a table of one
    row per range, broadcast: its size is the partition count)."""
    from ..session import write_through
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = write_through(df.repartitionByRange(n, key, *order).withColumn("__pid", F.spark_partition_id()),
                           "lag-ranges")
    local_prev = F.lag(ts).over(Window.partitionBy("__pid", key).orderBy(*order))
    last_of_range = ranged.groupBy("__pid").agg(F.max(F.struct(key, *order)).alias("__last"))
    # previous non-empty range's last row; a window over one row per range
    bounds = last_of_range.select(
        "__pid", F.lag("__last").over(Window.orderBy("__pid")).alias("__plast")).select(
        "__pid", F.col("__plast")[key].alias("__pkey"), F.col("__plast")[ts].alias("__pts"))
    j = ranged.withColumn("__prev", local_prev).join(F.broadcast(bounds), "__pid", "left")
    prev = F.when(F.col("__prev").isNull() & F.col(key).eqNullSafe(F.col("__pkey")), F.col("__pts")) \
        .otherwise(F.col("__prev"))
    res = j.withColumn(out, F.datediff(F.to_date(ts), F.to_date(prev)).cast("bigint"))
    return res.select(*df.columns, out)


def numbered(df: DataFrame, key: str, order: Sequence[str | Column], out: str = "row_number",
             partitions: int | None = None) -> DataFrame:
    """Position (1, 2, ..) of every row among the rows of its ``key`` in
    ``order`` (ascending; nulls first), as ``ROW_NUMBER() OVER (PARTITION BY
    key ORDER BY order)``, without a whole key in one task.

    The rows are range-partitioned on (key, *order), so that a heavy key is
    split into balanced ranges, numbered inside (range, key) and written once
    with their range. Only the first key of a range can have begun in an
    earlier one: its rows so far are a running sum over one row per range,
    which is broadcast. ``order`` should be total: rows equal in it all fall
    into one range. A NULL key is a key like any other."""
    from ..session import write_through
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, F.col(key), *cols).withColumn("__pid", F.spark_partition_id())
    local = F.row_number().over(Window.partitionBy("__pid", key).orderBy(*cols)).cast("long")
    ranged = write_through(ranged.withColumn("__i", local), "numbered")
    ends = ranged.groupBy("__pid").agg(F.min(F.struct(key)).alias("__first"), F.max(F.struct(key, "__i")).alias("__last"))
    ends = ends.select("__pid", F.col("__first")[key].alias("__first"), F.col("__last")[key].alias("__last"),
                       F.col("__last")["__i"].alias("__n"))
    so_far = F.sum("__n").over(Window.partitionBy("__last").orderBy("__pid"))
    before = Window.orderBy("__pid")  # one row per range
    ends = ends.withColumn("__n", so_far).select(
        "__pid", "__first", F.lag("__last").over(before).alias("__plast"), F.lag("__n").over(before).alias("__pn"))
    ends = ends.where(F.col("__pn").isNotNull() & F.col("__first").eqNullSafe(F.col("__plast")))
    j = ranged.join(F.broadcast(ends), "__pid", "left")
    earlier = F.when(F.col("__pn").isNotNull() & F.col(key).eqNullSafe(F.col("__first")), F.col("__pn")).otherwise(0)
    return j.select(*df.columns, (F.col("__i") + earlier).alias(out))
