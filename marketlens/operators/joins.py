"""Join operators (J1-J11) that are more than one ``join`` call.

Plain equi-joins, semi and anti joins are written in the plans. Dimension
tables whose size is fixed (nation, one-row aggregates) are broadcast
explicitly; every other join is left to AQE, which converts it to a broadcast
hash join only when the measured shuffle output is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits skewed
partitions of a sort-merge join otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1 / 400  # a key with more than this share of the rows is heavy
PIECES = 16  # pieces of a heavy key per shuffle partition it would fill


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> dict[int, float]:
    """Key hash -> share of the rows, for the keys that hold more than
    ``share`` of ``df``. A frequent-items sketch per partition, merged to one
    row: its size, and the number of keys that come back, are bounded by the
    share, whatever the data. A sketch may overrate a key, never miss one."""
    top = math.ceil(1 / share)
    row = df.select(_key_hash(keys).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {top}, {25 * top})").alias("top")).first()
    return {t["item"]: min(1.0, t["count"] / row["n"]) for t in row["top"] or [] if t["count"] > share * row["n"]}


def heavy_groups(groups: DataFrame, keys: Sequence[str], count: str, share: float = HOT_SHARE) -> dict[int, float]:
    """The same from exact counts per key, where they exist already; at most
    ``1 / share`` keys can be over the share."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    rows = groups.filter(F.col(count) > share * total).select(_key_hash(keys).alias("k"), F.col(count).alias("c")).collect()
    return {r["k"]: r["c"] / total for r in rows}


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                hot: dict[int, float] | None = None, pieces: int = PIECES) -> DataFrame:
    """Join on ``keys`` (inner, left, left_semi or left_anti; the keys appear
    once) whose heavy keys are spread over all tasks: the left rows of a heavy
    key are dealt over as many salts as its measured share needs, and its right
    rows are repeated once per salt. Other keys have one salt and nothing is
    repeated. ``hot`` is the measure (``heavy_keys`` of the left side by
    default). A left row has one salt, so no row is met twice. For a right side
    with few rows per key: the repeats of a heavy key are
    ``pieces * partitions * share``."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    hot = heavy_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, list(keys), how)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.create_map(*[F.lit(x) for k, s in hot.items() for x in (k, max(1, math.ceil(pieces * parts * s)))])
    n_salts = F.coalesce(F.try_element_at(salts, _key_hash(keys)), F.lit(1))
    plain = [c.name for c in left.schema if isinstance(c.dataType, T.AtomicType)]
    dealt = left.withColumn("__salt", F.pmod(
        F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in plain]), n_salts).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the keys appear once. Without
    keys every row meets every row: ``right`` is then one row per rank."""
    if not keys:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(F.broadcast(right), how=how)
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(other, cond, how).drop(*[f"__r_{c}" for c in keys])


def cross_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (scalar subquery) to every row.
    The right side has exactly one row by construction: broadcast is safe."""
    return df.crossJoin(F.broadcast(one_row))


def join_unique(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str) -> DataFrame:
    """Left join on differently named keys with one ``value`` of the
    right side; a right key with several rows is an error, not a silent
    multiplication of the left rows."""
    once = right.groupBy(right_key).agg(F.count(F.lit(1)).alias("__n"), F.max(value).alias("__v")).select(
        F.col(right_key).alias("__k"),
        F.when(F.col("__n") == 1, F.col("__v")).otherwise(
            F.raise_error(F.concat(F.lit(f"several rows of {right_key} "), F.col(right_key).cast("string"))))
        .alias(value))
    return left.join(once, F.col(left_key) == F.col("__k"), "left").drop("__k")


def full_outer_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str, out: str) -> DataFrame:
    """Full outer join of two aggregates; ``out`` is the coalesced
    key, both raw keys stay (NULL where unmatched)."""
    j = left.join(right, F.col(left_key) == F.col(right_key), "full_outer")
    return j.withColumn(out, F.coalesce(left_key, right_key))
