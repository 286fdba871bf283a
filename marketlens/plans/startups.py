"""Startup funding: cleaning, funding terms, market tiers, IQR outliers,
active years, funding types, yearly rounds, growth segments, return ratio
(Z15-Z22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import numeric_round
from ..operators.aggregates import (measure_totals, pivot_sum, ratio_capped, totals_and_positive_counts,
                                    with_exact_quantiles)
from ..operators.clean import (drop_full_duplicates, fill_nulls, impute_midpoint_date, lower_columns, narrow,
                               normalize_headers, replace_text, sentinel_to_null, to_number, to_timestamp_text)
from ..operators.outliers import flagged_share, iqr_flag, iqr_quartiles, keep_groups_over_threshold
from ..session import DENSE, shared_table, write_through
from ..sources import standins as S
from ..sources.tables import Tables, inputs

TEXT_COLUMNS = ("name", "market", "status")
DATE_COLUMNS = ("founded_at", "first_funding_at", "mid_funding_at", "last_funding_at")
# Market tiers by number of companies (> 120 mass, 35..120 mid,
# below 35 niche), and the minimum rounds for a year to be kept.
MASS_ABOVE = 120
MID_FROM = 35
MIN_YEAR_ROUNDS = 50
RATIO_TYPES = ("venture", "debt_financing", "private_equity", "seed", "angel")


def funding_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z15, shared by all startup reports (written once per application)."""
    return shared_table(spark, f"funding_clean:{sf_dir}", lambda: build_funding_clean(spark, sf_dir),
                        inputs(sf_dir, "lineitem", "orders", "part"))


def build_funding_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, amount text to number, dates with a fixed format, integer
    rounds, text gaps to 'unknown', lower case, full duplicates removed,
    nameless and unfunded rows dropped, missing middle date imputed."""
    raw = normalize_headers(S.startup_investments_raw(Tables(spark, sf_dir)))
    typed = raw.withColumns({
        "funding_total_usd": to_number(replace_text("funding_total_usd", ",", ""), "double"),
        "funding_rounds": narrow("funding_rounds", "bigint"),
        **{c: to_timestamp_text(c, "yyyy-MM-dd") for c in DATE_COLUMNS},
    })
    filled = lower_columns(fill_nulls(typed, {c: "unknown" for c in TEXT_COLUMNS}), TEXT_COLUMNS)
    # written once: the duplicates are found in a scan of it, and only they move
    dedup = drop_full_duplicates(write_through(filled, "startups-typed", DENSE))
    named = dedup.withColumn("name", sentinel_to_null("name", "unknown")).na.drop(subset=["name"])
    kept = named.na.drop(subset=["funding_total_usd", "first_funding_at", "last_funding_at"])
    return kept.withColumn("mid_funding_at",
                           impute_midpoint_date("first_funding_at", "last_funding_at", "mid_funding_at"))


def _funding_group(df: DataFrame) -> DataFrame:
    """Duration in whole days and the funding-term class."""
    days = F.datediff(F.to_date("last_funding_at"), F.to_date("first_funding_at"))
    grp = (F.when(F.col("funding_rounds") == 1, "single round")
            .when(F.col("funding_duration_days") <= 365, "up to a year")
            .otherwise("over a year"))
    return df.withColumn("funding_duration_days", days).withColumn("funding_group", grp)


def funding_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of companies and percent of money per funding-term group."""
    d = _funding_group(funding_clean(spark, sf_dir))
    per = d.groupBy("funding_group").agg(F.count(F.lit(1)).alias("companies"),
                                         F.sum("funding_total_usd").alias("money"))
    tot = per.agg(F.sum("companies").alias("__c"), F.sum("money").alias("__m"))
    return per.crossJoin(F.broadcast(tot)).select(
        "funding_group", "companies",
        numeric_round(F.col("companies") / F.col("__c") * 100, 4).alias("companies_pct"),
        numeric_round(F.col("money") / F.col("__m") * 100, 4).alias("money_pct"))


def _market_counts(df: DataFrame) -> DataFrame:
    tier = (F.when(F.col("count") > MASS_ABOVE, "mass")
             .when(F.col("count") >= MID_FROM, "mid").otherwise("niche"))
    return df.groupBy("market").agg(F.count(F.lit(1)).alias("count")).withColumn("category", tier)


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies and tier of every market, one row each, written once: joins
    know its size, and the companies only move to meet it where it is large."""
    return shared_table(spark, f"startup_markets:{sf_dir}", lambda: _market_counts(funding_clean(spark, sf_dir)),
                        inputs(sf_dir, "lineitem", "orders", "part"))


def market_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets per tier and companies per tier."""
    seg = _markets(spark, sf_dir)
    return seg.groupBy("category").agg(F.count("market").alias("segment_count"),
                                       F.sum("count").alias("company_count"))


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare markets pooled into 'mid' and 'niche' (mass markets keep
    their name). The tier table has one row per market and is joined, not
    collected into a driver-side dict."""
    d = _funding_group(funding_clean(spark, sf_dir))
    seg = _markets(spark, sf_dir)
    label = F.when(F.col("category") == "mass", F.col("market")).otherwise(F.col("category"))
    return d.join(seg.select("market", label.alias("__m")), "market", "left") \
        .withColumn("market", F.col("__m")).drop("__m")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 on relabelled markets (N25: all rare markets share one fence). Only
    the quartiles, one row per market, are written for the outlier, year, type
    and ratio reports; the flag is derived from them in each."""
    labelled = relabelled(spark, sf_dir)
    quartiles = shared_table(spark, f"startup_quartiles:{sf_dir}",
                             lambda: iqr_quartiles(labelled, "funding_total_usd", "market"),
                             inputs(sf_dir, "lineitem", "orders", "part"))
    return iqr_flag(labelled, "funding_total_usd", "market", 1.5, "is_outlier", quartiles)


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies, outliers and outlier percent per market, top 10."""
    res = flagged_share(_flagged(spark, sf_dir), "market", "is_outlier", k=None)
    return res.select("market", F.col("n_rows").alias("total"), F.col("n_flagged").alias("outliers"),
                      numeric_round(F.col("flagged_share") * 100, 4).alias("ratio")) \
        .orderBy(F.desc("ratio"), "market").limit(10)


def final_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers removed; years (of the middle funding date) with at
    least 50 rounds kept."""
    normal = _flagged(spark, sf_dir).filter(~F.col("is_outlier")).withColumn(
        "year", F.year("mid_funding_at").cast("bigint"))
    return keep_groups_over_threshold(normal, "year", "funding_rounds", MIN_YEAR_ROUNDS)


def active_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rounds per kept year, months present and their number."""
    fd = final_data(spark, sf_dir)
    return fd.groupBy("year").agg(F.sum("funding_rounds").alias("rounds"),
                                  F.count_distinct(F.month("mid_funding_at")).cast("bigint").alias("n_months"),
                                  F.array_join(F.sort_array(F.collect_set(F.month("mid_funding_at"))), ",")
                                  .alias("months"))


def funding_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money and popularity per funding type, and the returns of
    the type over all years."""
    fd = final_data(spark, sf_dir)
    money = totals_and_positive_counts(fd, S.FUNDING_TYPES, "funding_type", "total_money", "popularity")
    ret_types = list(S.RETURN_PRIORITY_OF)
    ret = measure_totals(S.startup_returns(Tables(spark, sf_dir)), ret_types, "funding_type", "total_returns")
    return money.join(ret, "funding_type", "left").select(
        "funding_type", numeric_round("total_money", 2).alias("total_money"), "popularity",
        numeric_round("total_returns", 6).alias("total_returns"))


def yearly_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year, median of the mean round size and the number of rounds."""
    fd = final_data(spark, sf_dir).withColumn(
        "avg_round_amount", F.col("funding_total_usd") / F.col("funding_rounds"))
    agg = fd.groupBy("year").agg(F.sum("funding_rounds").alias("total_rounds"))
    agg = with_exact_quantiles(agg, fd, "avg_round_amount", [0.5], "year", ["__m"])
    return agg.select("year", numeric_round("__m", 4).alias("avg_round_median"), "total_rounds").orderBy("year")


def growth_segments(spark: SparkSession, sf_dir: str, year_from: int = 1999, year_to: int = 2000) -> DataFrame:
    """Mass markets whose total funding grew from ``year_from`` to
    ``year_to`` (pooled labels excluded), with both totals. The two pivot
    rows are conditional sums in one aggregate."""
    fd = final_data(spark, sf_dir)
    per = fd.groupBy("market").agg(
        F.sum(F.when(F.col("year") == year_from, F.col("funding_total_usd")).otherwise(0.0)).alias("total_from"),
        F.sum(F.when(F.col("year") == year_to, F.col("funding_total_usd")).otherwise(0.0)).alias("total_to"))
    return per.filter((F.col("total_to") > F.col("total_from"))
                      & ~F.col("market").isin("mid", "niche", "unknown")).select(
        "market", numeric_round("total_from", 2).alias("total_from"), numeric_round("total_to", 2).alias("total_to"))


def segment_year_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total funding per market and year as a wide table, missing = 0, with
    a column for every year of the data."""
    wide = _year_matrix(final_data(spark, sf_dir))
    return wide.select("market", *[numeric_round(F.col(y), 2).alias(f"y{y}") for y in wide.columns[1:]])


def _year_matrix(fd: DataFrame) -> DataFrame:
    """The money per market and year is summed once; the wide table and its
    years come from these few rows."""
    money = fd.filter(F.col("market").isNotNull()).groupBy("market", "year").agg(F.sum("funding_total_usd").alias("total"))
    return pivot_sum(write_through(money, "segment-years"), "market", "year", "total")


def growing_segments_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growing mass segments with their totals of every year, in
    long form (the transposed table), years without money = 0."""
    wide = segment_year_matrix(spark, sf_dir)
    grown = wide.join(growth_segments(spark, sf_dir).select("market"), "market", "left_semi")
    if len(wide.columns) == 1:  # no year at all
        return grown.select("market", F.lit(None).cast("bigint").alias("year"), F.lit(None).cast("double").alias("total"))
    return grown.unpivot(["market"], wide.columns[1:], "y", "total").select(
        "market", F.substring("y", 2, 9).cast("bigint").alias("year"), "total")


def return_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invested millions per year and type against the returns
    of the year; ratio above 2 set to NULL; only years in both tables."""
    fd = final_data(spark, sf_dir)
    invested = fd.groupBy("year").agg(*[(F.sum(t) / 1e6).alias(t) for t in RATIO_TYPES])
    ret = S.startup_returns(Tables(spark, sf_dir)).select("year", *RATIO_TYPES)
    j = ret.alias("x").join(invested.alias("y"), "year", "inner")
    return j.select("year", *[numeric_round(ratio_capped(F.col(f"x.{t}"), F.col(f"y.{t}") + F.lit(1e-60), 2.0), 6)
                              .alias(f"{t}_ratio") for t in RATIO_TYPES]).orderBy("year")


def funding_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z15 as a registered query (dates as ISO text)."""
    d = funding_clean(spark, sf_dir)
    return d.select("name", "market", "status", "funding_total_usd", "funding_rounds",
                    *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in DATE_COLUMNS],
                    *S.FUNDING_TYPES)

