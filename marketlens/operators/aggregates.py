"""Aggregation operators.

Every operator is a lazy DataFrame -> DataFrame function. Aggregates are
partial (map-side combine) wherever Spark allows; frequency tables and shares
compute totals with a one-row aggregate attached by broadcast instead of
windows over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_div


MAX_PIVOT = 2000  # columns of a wide table


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# ------------------------------------------------------------------ percentiles

def percentile_expr(value: str, q: float, kind: str = "cont", accuracy: int | None = None) -> Column:
    """Exact interpolated (``cont``) or discrete (``disc``) percentile, or a
    bounded-memory sketch when ``accuracy`` is given.

    The exact forms keep a value -> count map per group in the aggregation
    buffer (partial per partition, merged per group); ``accuracy`` switches
    to ``percentile_approx`` whose buffer size does not grow with the data.
    """
    if accuracy is not None:
        return F.percentile_approx(value, q, accuracy)
    if kind == "cont":
        return F.percentile(value, F.lit(q))
    if kind == "disc":
        return F.expr(f"percentile_disc({q!r}) WITHIN GROUP (ORDER BY `{value}`)")
    raise ValueError(kind)


def with_exact_quantiles(agg: DataFrame, df: DataFrame, value: str, qs, by, names,
                         kind: str = "cont") -> DataFrame:
    """Attach exact percentiles of ``value`` (one column per name) to an
    aggregate ``agg`` keyed by ``by``; groups without values get NULL."""
    from .joins import null_safe_join
    from .quantiles import exact_quantiles
    keys = _keys(by)
    q = exact_quantiles(df, value, list(qs), by=keys, kind=kind, out_prefix="__wq").select(
        *keys, *[F.col(f"__wq_q{i}").alias(n) for i, n in enumerate(names)])
    return null_safe_join(agg, q, keys, "left") if keys else agg.crossJoin(q)


def discrete_percentile(df: DataFrame, value: str, q: float, by=None,
                        accuracy: int | None = None, out: str | None = None) -> DataFrame:
    """``PERCENTILE_DISC(q) WITHIN GROUP (ORDER BY value)`` per group
    (exact by histogram refinement; ``accuracy`` switches to a sketch)."""
    keys = _keys(by)
    if accuracy is not None:
        return df.groupBy(*keys).agg(percentile_expr(value, q, "disc", accuracy).alias(out or value))
    from .quantiles import exact_quantiles
    res = exact_quantiles(df, value, [q], by=keys, kind="disc", out_prefix="__d")
    return res.select(*keys, F.col("__d_q0").alias(out or value))


# ------------------------------------------------------------- grouped summaries

def describe(df: DataFrame, value: str, by=None, accuracy: int | None = None) -> DataFrame:
    """A4/A5: count, mean, std, min, 25%, 50%, 75%, max (pandas ``describe``),
    per group when ``by`` is given (NULL group keys dropped, as pandas does)."""
    keys = _keys(by)
    src = df
    for k in keys:
        src = src.filter(F.col(k).isNotNull())
    moments = src.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    if accuracy is None:
        from .quantiles import exact_quantiles
        q = exact_quantiles(src, value, [0.25, 0.5, 0.75], by=keys, out_prefix="__d").select(
            *keys, F.col("__d_q0").alias("q25"), F.col("__d_q1").alias("q50"), F.col("__d_q2").alias("q75"))
    else:
        qs = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
        q = src.groupBy(*keys).agg(qs.alias("_q")).select(
            *keys, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"))
    # groups whose values are all NULL keep NULL quartiles (left join)
    j = moments.join(q, keys, "left") if keys else moments.crossJoin(q)
    return j.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, cols: str | Sequence[str], normalize: bool = False,
                 dropna: bool = True, out: str = "count") -> DataFrame:
    """Frequency table; ``normalize`` gives percent of the non-NULL
    total. The total is a one-row aggregate of the (small) frequency table."""
    keys = _keys(cols)
    src = df
    if dropna:
        for k in keys:
            src = src.filter(F.col(k).isNotNull())
    counts = src.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    if not normalize:
        return counts
    total = counts.agg(F.sum(out).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select(
        *keys, out, (F.col(out) * 100.0 / F.col("__total")).alias("percent"))


def sorted_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values of each column in order, in long form (NULL
    dropped); one pass over the rows for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    return df.select(pairs.alias("__p")).select("__p.*").filter(F.col("value").isNotNull()) \
        .distinct().orderBy("column", "value")


def pivot_sum(df: DataFrame, index: str | Sequence[str], columns: str, values: str,
              column_values: Sequence | None = None, fill: float = 0.0) -> DataFrame:
    """``pivot_table(index, columns, values, 'sum', fill_value=0)``. The
    columns are the values found in the data, in order (one more job, which
    reads that column alone; more than ``MAX_PIVOT`` of them are an error), or
    those passed in. NULL is no column."""
    if column_values is None:
        found = df.select(columns).where(F.col(columns).isNotNull()).distinct().limit(MAX_PIVOT + 1).collect()
        if len(found) > MAX_PIVOT:
            raise ValueError(f"more than {MAX_PIVOT} values of {columns}")
        column_values = sorted(r[0] for r in found)
    return (df.groupBy(*_keys(index)).pivot(columns, list(column_values)).agg(F.sum(values))
              .na.fill(fill, subset=[str(v) for v in column_values]))


def measure_totals(df: DataFrame, measures: Sequence[str], name_col: str = "measure",
                   value_col: str = "total") -> DataFrame:
    """Sum of each measure column, in long form (one row per measure)."""
    wide = df.agg(*[F.sum(m).alias(m) for m in measures])
    return wide.unpivot([], list(measures), name_col, value_col)


def totals_and_positive_counts(df: DataFrame, measures: Sequence[str], name_col: str, total_col: str,
                               count_col: str) -> DataFrame:
    """Per measure column its sum and the number of rows with a
    positive value, in long form, from one aggregate over the rows."""
    pairs = df.agg(*[F.struct(F.lit(m).alias(name_col), F.sum(m).alias(total_col),
                              F.count_if(F.col(m) > 0).alias(count_col)).alias(f"__{i}")
                     for i, m in enumerate(measures)])
    return pairs.select(F.explode(F.array(*[f"__{i}" for i in range(len(measures))])).alias("__m")).select("__m.*")


def ratio_capped(num, den, cap: float | None = None) -> Column:
    """Num / den with a zero divisor giving NULL and values above ``cap``
    set to NULL."""
    r = safe_div(num, den)
    return F.when(r > cap, F.lit(None).cast("double")).otherwise(r) if cap is not None else r

