"""Product metrics (M1-M9): DAU, conversion, average check, LTV, retention.

All are grouped aggregates. Distinct users per day are counted by Spark's
two-phase distinct aggregation (dedupe on (day, user) map-side first).
Retention attaches each user's first day by an aggregate joined back, so a
user with a third of all events is split by AQE rather than sorted in one
task, and the day grid comes from ``sequence`` so days without returns show 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dau(df: DataFrame, user: str, ts: str) -> DataFrame:
    """M1: distinct active users per day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count_distinct(user).alias("dau"))


def daily_conversion(df: DataFrame, user: str, ts: str, is_order) -> DataFrame:
    """M2: users with an order / active users, per day."""
    g = df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count_distinct(user).alias("active_users"),
        F.count_distinct(F.when(is_order, F.col(user))).alias("ordering_users"))
    return g.withColumn("conversion", F.col("ordering_users") / F.col("active_users"))


def average_check(df: DataFrame, ts: str, revenue: str, is_order, period: str = "month") -> DataFrame:
    """M3: revenue / orders per period (money summed as exact decimals)."""
    g = df.filter(is_order).groupBy(F.date_trunc(period, ts).alias("period")).agg(
        F.sum(F.col(revenue).cast("decimal(18,2)")).cast("double").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return g.withColumn("avg_check", F.col("revenue") / F.col("orders"))


def ltv_top(df: DataFrame, key: str, revenue: str, k: int) -> DataFrame:
    """M4: total value per key over the period, top k (ties by key)."""
    return df.groupBy(key).agg(F.sum(revenue).alias("ltv")).orderBy(F.desc("ltv"), key).limit(k)


def retention(df: DataFrame, user: str, ts: str, cohort: str | None = None) -> DataFrame:
    """M5/M6: share of the cohort active on each day since its first day.
    ``cohort`` = None for one common cohort, or a ``date_trunc`` unit
    ('month') for calendar cohorts of the first day."""
    d = df.select(user, F.to_date(ts).alias("__d")).distinct()  # one row per user and day for all that follows
    first = d.groupBy(user).agg(F.min("__d").alias("__first"))
    coh = F.lit("all") if cohort is None else F.date_format(F.date_trunc(cohort, "__first"), "yyyy-MM-dd")
    first = first.withColumn("cohort", coh)
    act = d.join(first, user).select(user, "cohort", F.datediff("__d", "__first").alias("day_offset"))
    counts = act.groupBy("cohort", "day_offset").agg(F.count(user).alias("retained_users"))
    sizes = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    span = act.groupBy("cohort").agg(F.max("day_offset").alias("__max"))
    grid = sizes.join(span, "cohort").select(
        "cohort", "cohort_size", F.explode(F.sequence(F.lit(0), F.col("__max"))).alias("day_offset"))
    j = grid.join(counts, ["cohort", "day_offset"], "left").fillna(0, subset=["retained_users"])
    return j.select("cohort", F.col("day_offset").cast("bigint").alias("day_offset"), "cohort_size",
                    "retained_users", (F.col("retained_users") / F.col("cohort_size")).alias("retention_rate"))
