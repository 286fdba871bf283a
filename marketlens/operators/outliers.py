"""Percentile caps, fences and group thresholds.

Bounds are computed as aggregates (a one-row frame, or one row per group)
and attached by a broadcast join, so filtering is a single map-side pass
over the data: no window over a group key, and no Python loop over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .aggregates import percentile_expr
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class Bound:
    """One percentile bound: ``column op percentile(q)``; NULL values pass when
    ``null_passes`` (``... OR column IS NULL``)."""
    column: str
    q: float
    kind: str = "cont"  # cont | disc
    op: str = "<"       # < <= > >=
    null_passes: bool = True


_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def percentile_limits(df: DataFrame, bounds: Sequence[Bound], accuracy: int | None = None) -> DataFrame:
    """One-row frame with one limit column per bound (``limits`` CTE).

    Exact limits: the bounds of a column share the two passes of
    ``exact_quantiles`` over that column alone; no row is repeated for the
    bounds of other columns."""
    if accuracy is not None:
        return df.agg(*[percentile_expr(b.column, b.q, b.kind, accuracy).alias(f"__lim{i}")
                        for i, b in enumerate(bounds)])
    limits = None
    for c in sorted({b.column for b in bounds}):
        specs = sorted({(b.q, b.kind) for b in bounds if b.column == c})
        found = exact_quantiles(df, c, [q for q, _ in specs], kind=[k for _, k in specs], out_prefix="__p")
        mine = found.agg(*[F.max(f"__p_q{specs.index((b.q, b.kind))}").alias(f"__lim{i}")
                           for i, b in enumerate(bounds) if b.column == c])  # one row, also without values
        limits = mine if limits is None else limits.crossJoin(F.broadcast(mine))
    return limits.select(*[f"__lim{i}" for i in range(len(bounds))])


def _bound_condition(bounds: Sequence[Bound]) -> Column:
    """AND over columns; bounds on the same column are ANDed before the NULL
    escape, as in ``((c < hi AND c > lo) OR c IS NULL)``."""
    by_col: dict[str, list[tuple[int, Bound]]] = {}
    for i, b in enumerate(bounds):
        by_col.setdefault(b.column, []).append((i, b))
    cond = F.lit(True)
    for c, items in by_col.items():
        part = F.lit(True)
        for i, b in items:
            part = part & _OPS[b.op](F.col(c), F.col(f"__lim{i}"))
        if any(b.null_passes for _, b in items):
            part = part | F.col(c).isNull()
        cond = cond & part
    return cond


def filter_by_global_percentiles(df: DataFrame, bounds: Sequence[Bound], limits_from: DataFrame | None = None,
                                 accuracy: int | None = None) -> DataFrame:
    """keep rows inside global two-sided percentile bounds, strict compare,
    NULL passing. Limits come from ``limits_from`` (default ``df``)."""
    lim = percentile_limits(limits_from if limits_from is not None else df, bounds, accuracy)
    j = df.crossJoin(F.broadcast(lim))  # exactly one row
    return j.filter(_bound_condition(bounds)).drop(*[f"__lim{i}" for i in range(len(bounds))])


def cap_by_group_percentile(df: DataFrame, value: str, group: str, q: float = 0.99,
                            groups: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """keep rows with ``value <= percentile_q`` computed within each group
    (p99 per currency), in one pass instead of split / cap / concat. Only the
    listed ``groups`` are kept, as splitting by them would do (N8)."""
    src = df.filter(F.col(group).isin(*groups)) if groups else df
    caps = group_caps(src, value, group, q, accuracy).withColumnRenamed("cap", "__cap")
    # one row per group of a categorical key: small, but its size is only
    # known at run time, so AQE decides on broadcasting it.
    return src.join(caps, group, "inner").filter(F.col(value) <= F.col("__cap")).drop("__cap")


def group_caps(df: DataFrame, value: str, group: str, q: float = 0.99,
               accuracy: int | None = None) -> DataFrame:
    """Interpolated percentile ``q`` of ``value`` per group (exact by default)."""
    if accuracy is not None:
        return df.groupBy(group).agg(percentile_expr(value, q, "cont", accuracy).alias("cap"))
    return exact_quantiles(df, value, [q], by=group, out_prefix="__c").withColumnRenamed("__c_q0", "cap")


def iqr_quartiles(df: DataFrame, value: str, group: str, accuracy: int | None = None) -> DataFrame:
    """Q1 and Q3 of ``value`` per group: one row per group."""
    if accuracy is None:
        return exact_quantiles(df, value, [0.25, 0.75], by=group, out_prefix="__f").select(
            group, F.col("__f_q0").alias("__q1"), F.col("__f_q1").alias("__q3"))
    qexpr = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.75)), accuracy)
    return df.groupBy(group).agg(qexpr.alias("__q")).select(
        group, F.col("__q")[0].alias("__q1"), F.col("__q")[1].alias("__q3"))


def iqr_flag(df: DataFrame, value: str, group: str, k: float = 1.5, out: str = "is_outlier",
             quartiles: DataFrame | None = None) -> DataFrame:
    """flag values outside [Q1 - k*IQR, Q3 + k*IQR] of their group."""
    j = df.join(iqr_quartiles(df, value, group) if quartiles is None else quartiles, group, "left")
    iqr = F.col("__q3") - F.col("__q1")
    flag = (F.col(value) < F.col("__q1") - k * iqr) | (F.col(value) > F.col("__q3") + k * iqr)
    return j.withColumn(out, F.coalesce(flag, F.lit(False))).drop("__q1", "__q3")


def flagged_share(df: DataFrame, group: str, flag: str, k: int | None = 10) -> DataFrame:
    """rows, flagged rows and flagged share per group; top ``k`` by share."""
    agg = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"),
                                F.count_if(F.col(flag)).alias("n_flagged"))
    res = agg.withColumn("flagged_share", F.col("n_flagged") / F.col("n_rows"))
    return res.orderBy(F.desc("flagged_share"), group).limit(k) if k else res


def groups_over_threshold(df: DataFrame, group: str, measure: str | None, threshold: float) -> DataFrame:
    """F9 helper: groups whose total (or row count) reaches ``threshold``."""
    total = F.sum(measure) if measure else F.count(F.lit(1))
    return df.groupBy(group).agg(total.alias("__t")).filter(F.col("__t") >= threshold).select(group)


def keep_groups_over_threshold(df: DataFrame, group: str, measure: str | None, threshold: float) -> DataFrame:
    """keep rows of groups whose total reaches the threshold (semi join).
    The groups, one row each, are written first: their size is known then, and
    while it is small the rows of ``df`` stay where they are instead of meeting
    by group, of which there may be few."""
    return df.join(write_through(groups_over_threshold(df, group, measure, threshold), "groups"), group, "left_semi")


def rows_at_or_above_percentile(df: DataFrame, value: str, q: float, accuracy: int | None = None) -> DataFrame:
    """rows with value >= the global percentile."""
    lim = (df.agg(percentile_expr(value, q, "cont", accuracy).alias("__p")) if accuracy is not None
           else exact_quantiles(df, value, [q], out_prefix="__x").select(F.col("__x_q0").alias("__p")))
    return df.crossJoin(F.broadcast(lim)).filter(F.col(value) >= F.col("__p")).drop("__p")


def rows_of_top_entity(df: DataFrame, key: str, child: str) -> DataFrame:
    """rows of the entity with the most distinct children (ties broken by
    the smaller key)."""
    top = (df.groupBy(key).agg(F.count_distinct(child).alias("__n"))
             .orderBy(F.desc("__n"), F.asc(key)).limit(1).select(key))
    return df.join(F.broadcast(top), key, "left_semi")

