"""Video games: cleaning, score categories, top platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import sorted_distinct
from ..operators.clean import drop_full_duplicates, narrow, recode, rename_columns
from ..sources import standins as S
from ..sources.tables import Tables

# Snake-case header of the games table.
GAME_COLUMNS = {
    "Name": "name", "Platform": "platform", "Year of Release": "year_of_release", "Genre": "genre",
    "NA sales": "na_sales_mm", "EU sales": "eu_sales_mm", "JP sales": "jp_sales_mm",
    "Other sales": "other_sales_mm", "Critic Score": "critic_score", "User Score": "user_score",
    "Rating": "rating",
}
# Left-closed score bins (labels, edges) of the two scales.
USER_BINS = (("low", 0, 3), ("mid", 3, 8), ("high", 8, 10))
CRITIC_BINS = (("low", 0, 30), ("mid", 30, 80), ("high", 80, 100))
YEARS = (2000, 2013)


def left_closed_bins(c: str, bins, outside: str = "unknown", include_top: bool = False) -> Column:
    """``pd.cut(right=False)``: [a, b) bins; values outside (and NULL)
    get the marker. ``include_top`` closes the last bin on the right."""
    expr = None
    for i, (label, lo, hi) in enumerate(bins):
        upper = (F.col(c) <= hi) if (include_top and i == len(bins) - 1) else (F.col(c) < hi)
        cond = (F.col(c) >= lo) & upper
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(outside))


def games_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snake-case header, rows without name/genre/year dropped, sales text
    to numbers, 'tbd' to NULL before the -1 fill (N11), integer year and
    critic score, lower-case name/genre, upper-case rating with K-A recoded
    to E and the missing-rating marker applied last (N10), full duplicates
    removed."""
    df = rename_columns(S.games_raw(Tables(spark, sf_dir)), GAME_COLUMNS)
    df = df.na.drop(subset=["name", "genre", "year_of_release"])
    df = df.withColumns({
        "eu_sales_mm": F.col("eu_sales_mm").try_cast("double"),
        "jp_sales_mm": F.col("jp_sales_mm").try_cast("double"),
        "user_score": F.coalesce(F.col("user_score").try_cast("double"), F.lit(-1.0)),
        "critic_score": narrow(F.coalesce(F.col("critic_score"), F.lit(-1.0)), "int"),
        "year_of_release": narrow("year_of_release", "int"),
        "name": F.lower("name"), "genre": F.lower("genre"), "rating": F.upper("rating"),
    })
    df = recode(df, "rating", {"K-A": "E"}).withColumn("rating", F.coalesce("rating", F.lit("unknown")))
    return drop_full_duplicates(df)


def games_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = YEARS
    g = games_clean(spark, sf_dir).filter(F.col("year_of_release").between(lo, hi))
    return g.withColumn("user_score_category", left_closed_bins("user_score", USER_BINS)) \
            .withColumn("critic_score_category", left_closed_bins("critic_score", CRITIC_BINS))


def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games per (user score category, critic score category)."""
    g = games_actual(spark, sf_dir)
    return g.groupBy("user_score_category", "critic_score_category").agg(F.count(F.lit(1)).alias("games"))


def top_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the 7 platforms with the most titles in the year window."""
    g = games_actual(spark, sf_dir)
    return g.groupBy("platform").agg(F.count("name").alias("games")) \
        .orderBy(F.desc("games"), "platform").limit(7)


def games_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games per (platform, genre) of the cleaned table."""
    g = games_clean(spark, sf_dir)
    return g.groupBy("platform", "genre").agg(F.count(F.lit(1)).alias("count"))


def games_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct platforms, years and ratings of the cleaned table."""
    return sorted_distinct(games_clean(spark, sf_dir), ["platform", "year_of_release", "rating"])
