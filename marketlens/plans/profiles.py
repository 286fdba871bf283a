"""Quality profiles, audits and distribution summaries (Q1-Q11, A4, A5,
X14, X15) on the driver tables and stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import numeric_round
from ..operators.aggregates import describe
from ..operators.experiments import boxplot_stats, histogram
from ..operators.quality import duplicate_counts, duplicated_rows, marker_counts, null_profile, null_totals
from ..sources import standins as S
from ..sources.tables import Tables

LINE_KEY = ("l_orderkey", "l_linenumber")


def _venues_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged venue table for counts of NULLs: the long hours text is the
    empty text from where it is read, so that the join does not move it."""
    t = Tables(spark, sf_dir)
    return S.venues_merged(t, S.venue_info(t).withColumn("hours", F.when(F.col("hours").isNotNull(), F.lit(""))))


def null_profile_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: NULL count and percent per column of the merged venue table."""
    p = null_profile(_venues_nulls(spark, sf_dir))
    return p.select("column", "n_null", numeric_round("null_pct", 4).alias("null_pct"))


def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3/Q4: only the columns with NULLs, largest share first."""
    p = null_profile(_venues_nulls(spark, sf_dir), only_missing=True)
    return p.select("column", "n_null", numeric_round("null_pct", 4).alias("null_pct")) \
        .orderBy(F.desc("n_null"), "column")


def null_totals_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: NULL cells and rows with any NULL in the merged venue table."""
    return null_totals(_venues_nulls(spark, sf_dir))


def marker_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: 'unknown' in the sales columns and 'tbd' in the user score."""
    g = S.games_raw(Tables(spark, sf_dir))
    return marker_counts(g, ["EU sales", "JP sales"], "unknown").unionByName(
        marker_counts(g, ["User Score"], "tbd"))


def duplicate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6/Q8: full-row and key duplicates of order lines."""
    li = Tables(spark, sf_dir).lineitem
    full = duplicate_counts(li).withColumn("scope", F.lit("full_row"))
    key = duplicate_counts(li, LINE_KEY).withColumn("scope", F.lit("order_line_key"))
    return full.unionByName(key)


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: every copy of order lines whose (order, line number) repeats."""
    li = Tables(spark, sf_dir).lineitem
    return duplicated_rows(li.select(*LINE_KEY, "l_partkey", "l_suppkey", "l_quantity"), LINE_KEY)


def event_value_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: describe() of the event value per event type."""
    d = describe(Tables(spark, sf_dir).events, "value", by="event_type")
    return d.select("event_type", "count", *[numeric_round(c, 6).alias(c) for c in
                                             ("mean", "std", "min", "q25", "q50", "q75", "max")])


def event_value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: describe() of the event value over all events."""
    d = describe(Tables(spark, sf_dir).events, "value")
    return d.select("count", *[numeric_round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def event_value_histogram(spark: SparkSession, sf_dir: str, bins: int = 20) -> DataFrame:
    """20 equal-width bins of the event value (last bin closed)."""
    h = histogram(Tables(spark, sf_dir).events, "value", bins)
    return h.select(F.col("bin").cast("bigint").alias("bin"), numeric_round("bin_left", 6).alias("bin_left"),
                    numeric_round("bin_right", 6).alias("bin_right"), "count")


def event_value_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, whiskers and outliers of the event value per type."""
    b = boxplot_stats(Tables(spark, sf_dir).events, "value", by="event_type")
    return b.select("event_type", *[numeric_round(c, 6).alias(c) for c in
                                    ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_outliers", "n")
