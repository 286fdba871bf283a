"""Catering market: cleaning, structure, ratings, bills, top chains,
association of the rating with venue attributes (Z23-Z25, X13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import numeric_round
from ..operators.aggregates import describe, value_counts, with_exact_quantiles
from ..operators.clean import contains_all, dedupe_keep_first, fill_nulls, lower_columns, narrow
from ..operators.experiments import chi_square_association
from ..operators.outliers import rows_at_or_above_percentile
from ..operators.quantiles import exact_quantiles
from ..session import shared_table, write_through
from ..sources import standins as S
from ..sources.tables import Tables, inputs

TEXT_COLUMNS = ("name", "category", "address", "district", "price")


def venues_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z23, shared by all venue reports (written once per application)."""
    return shared_table(spark, f"venues_clean:{sf_dir}", lambda: build_venues_clean(spark, sf_dir),
                        inputs(sf_dir, "documents", "labels"))


def build_venues_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain to boolean, seats to integer, 'unknown' for missing hours and
    price, lower-case text, duplicates on (name, address) removed keeping the
    smallest id. The opening-hours text becomes its two flags (24/7, exactly
    the 24/7 phrase) where it is read, before the prices are joined, and the
    narrow rows are written before the dedupe, which reads them twice: the long
    text is read once and never shuffled."""
    t = Tables(spark, sf_dir)
    hours = lower_columns(fill_nulls(S.venue_info(t), {"hours": "unknown"}), ["hours"])
    info = hours.withColumns({"is_24_7": contains_all("hours", S.HOURS_WORDS),
                              "hours_exact": F.col("hours") == F.lit(" ".join(S.HOURS_WORDS))}).drop("hours")
    m = S.venues_merged(t, info)
    typed = m.withColumns({"chain": narrow("chain", "boolean"), "seats": narrow("seats", "bigint")})
    filled = lower_columns(fill_nulls(typed, {"price": "unknown"}), TEXT_COLUMNS)
    flags = ["is_24_7", "hours_exact"]
    narrowed = filled.select(*[c for c in filled.columns if c not in flags], *flags)
    return dedupe_keep_first(write_through(narrowed, "venues"), ["name", "address"], ["id"])


def venues_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = venues_clean(spark, sf_dir)
    return v.select("id", "name", "category", "address", "district", "rating", "chain",
                    F.col("seats").cast("double").alias("seats"),
                    "price", "middle_avg_bill", "is_24_7")


def hours_flag_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues whose hours text is exactly the 24/7 phrase, the others,
    and the flag counts, in one conditional aggregate."""
    v = venues_clean(spark, sf_dir)
    return v.agg(F.count_if(~F.col("hours_exact")).alias("not_exact"), F.count_if("hours_exact").alias("exact"),
                 F.count_if("is_24_7").alias("flag_true"), F.count_if(~F.col("is_24_7")).alias("flag_false"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues per category and percent of all venues."""
    vc = value_counts(venues_clean(spark, sf_dir), "category", normalize=True)
    return vc.select("category", "count", numeric_round("percent", 4).alias("percent"))


def district_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues per district and percent of all venues."""
    vc = value_counts(venues_clean(spark, sf_dir), "district", normalize=True)
    return vc.select("district", "count", numeric_round("percent", 4).alias("percent"))


def district_category_mix(spark: SparkSession, sf_dir: str, district: str = "src0") -> DataFrame:
    """Categories of the venues of one district, counts and percent."""
    inside = venues_clean(spark, sf_dir).filter(F.col("district") == district)
    vc = value_counts(inside, "category", normalize=True)
    return vc.select("category", "count", numeric_round("percent", 4).alias("percent"))


def chain_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain / non-chain venues per category with total and percents."""
    v = venues_clean(spark, sf_dir)
    p = v.groupBy("category").agg(F.count_if(~F.col("chain")).alias("no_chain"),
                                  F.count_if(F.col("chain")).alias("chain"))
    tot = F.col("no_chain") + F.col("chain")
    return p.select("category", "no_chain", "chain", tot.alias("total"),
                    numeric_round(F.col("no_chain") / tot * 100, 4).alias("no_chain_pct"),
                    numeric_round(F.col("chain") / tot * 100, 4).alias("chain_pct")).orderBy(F.desc("total"), "category")


def rating_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: describe() of the rating per category."""
    d = describe(venues_clean(spark, sf_dir), "rating", by="category")
    return d.select("category", "count", *[numeric_round(c, 6).alias(c) for c in
                                           ("mean", "std", "min", "q25", "q50", "q75", "max")])


def rating_spread(spark: SparkSession, sf_dir: str, scale_range: float = 4.0) -> DataFrame:
    """(highest - lowest category mean rating) / scale range * 100."""
    v = venues_clean(spark, sf_dir).filter(F.col("category").isNotNull())
    means = v.groupBy("category").agg(F.avg("rating").alias("m"))
    return means.agg(numeric_round((F.max("m") - F.min("m")) / scale_range * 100, 4).alias("rating_diff_pct"))


def seats_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: median seats per category, and the p1 / p50 / p99 of all seats."""
    v = venues_clean(spark, sf_dir)
    per = with_exact_quantiles(v.select("category").distinct(), v, "seats", [0.5], "category", ["median_seats"])
    glob = exact_quantiles(v, "seats", [0.01, 0.5, 0.99], out_prefix="q")  # one row
    return per.crossJoin(F.broadcast(glob)).select(
        "category", numeric_round("median_seats", 4).alias("median_seats"),
        numeric_round("q_q0", 4).alias("p01_seats"), numeric_round("q_q1", 4).alias("p50_seats"),
        numeric_round("q_q2", 4).alias("p99_seats"))


def large_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venues with seats at or above the 99th percentile."""
    v = rows_at_or_above_percentile(venues_clean(spark, sf_dir), "seats", 0.99)
    return v.select("id", "name", "category", "seats")


def bill_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and mean of the middle bill per district."""
    v = venues_clean(spark, sf_dir)
    agg = v.groupBy("district").agg(numeric_round(F.avg("middle_avg_bill"), 4).alias("mean"))
    agg = with_exact_quantiles(agg, v, "middle_avg_bill", [0.5], "district", ["__m"])
    return agg.select("district", numeric_round("__m", 4).alias("median"), "mean").orderBy("median", "district")


def rating_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: mean rating per price category."""
    v = venues_clean(spark, sf_dir)
    return v.groupBy("price").agg(numeric_round(F.avg("rating"), 6).alias("mean_rating")) \
        .orderBy(F.desc("mean_rating"), "price")


def top_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain venues per (name, category) with mean rating; the 15
    largest, re-sorted by the mean rating. Ties at the cut go to the smaller
    (name, category)."""
    v = venues_clean(spark, sf_dir).filter(F.col("chain"))
    g = v.groupBy("name", "category").agg(F.count("id").alias("count"),
                                          numeric_round(F.avg("rating"), 6).alias("mean_rating"))
    top = g.orderBy(F.desc("count"), "name", "category").limit(15)
    return top.orderBy(F.desc_nulls_last("mean_rating"), "name", "category")


def top_chains_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: categories inside the top-15 chains."""
    return top_chains(spark, sf_dir).groupBy("category").agg(F.count("name").alias("chains"))


def _equal_width(value: str, lo: str, hi: str, bins: int):
    """Bin of a value between lo and hi, the last one closed; one bin if they are equal."""
    inner = F.floor((F.col(value) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / bins))
    return F.when(F.col(value).isNull(), F.lit(None).cast("int")).when(F.col(hi) == F.col(lo), F.lit(0)).otherwise(
        F.least(inner, F.lit(bins - 1)).cast("int"))


def _binned_venues(spark: SparkSession, sf_dir: str, bins: int) -> DataFrame:
    """Venues with rating_bin and seats_bin, both cut into equal-width bins."""
    v = venues_clean(spark, sf_dir)
    rng = v.agg(*[f(c).alias(f"{c}_{n}") for c in ("rating", "seats") for n, f in (("lo", F.min), ("hi", F.max))])
    return v.crossJoin(F.broadcast(rng)).withColumns(
        {f"{c}_bin": _equal_width(c, f"{c}_lo", f"{c}_hi", bins) for c in ("rating", "seats")})


def association_table(spark: SparkSession, sf_dir: str, bins: int = 10) -> DataFrame:
    """Association of the rating with category, district, chain, seats,
    price and the 24/7 flag: chi-square and Cramer's V per attribute. The
    interval columns (rating, seats) are cut into 10 equal-width bins (N29),
    NULL pairs are dropped."""
    b = _binned_venues(spark, sf_dir, bins)
    return chi_square_association(b, "rating_bin", ["category", "district", "chain", "seats_bin", "price", "is_24_7"])
