"""Real estate listings: activity by region and duration band, seasonality,
monitor (Z7, Z8, M16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_after_days, month_name, season
from ..functions.numeric import numeric_round, safe_div
from ..operators.aggregates import percentile_expr
from ..operators.joins import full_outer_on
from ..operators.outliers import Bound, filter_by_global_percentiles
from ..session import shared_table
from ..sources import standins as S
from ..sources.tables import Tables, inputs

# Outlier bounds of the listing analyses (limits CTE): p99 area (interpolated),
# p99 rooms and balconies (discrete), ceiling height inside (p1, p99).
LISTING_BOUNDS = (
    Bound("total_area", 0.99, "cont", "<", null_passes=False),
    Bound("rooms", 0.99, "disc", "<"),
    Bound("balcony", 0.99, "disc", "<"),
    Bound("ceiling_height", 0.99, "cont", "<"),
    Bound("ceiling_height", 0.01, "cont", ">"),
)


def clean_city_listings(spark: SparkSession, sf_dir: str, accuracy: int | None = None) -> DataFrame:
    """Listings without outliers, shared by the activity and seasonality
    reports (written once per application)."""
    return shared_table(spark, f"city_listings:{sf_dir}:{accuracy}",
                        lambda: build_clean_city_listings(spark, sf_dir, accuracy),
                        inputs(sf_dir, "lineitem", "orders", "customer", "nation"))


def build_clean_city_listings(spark: SparkSession, sf_dir: str, accuracy: int | None = None) -> DataFrame:
    """Listings without outliers, of the city type, published in the year
    window. The limits are those of all flats, a scan without the joins."""
    t = Tables(spark, sf_dir)
    kept = filter_by_global_percentiles(S.real_estate_listings(t), LISTING_BOUNDS, S.real_estate_flats(t), accuracy)
    lo, hi = S.REAL_ESTATE_YEARS
    return kept.filter((F.col("type") == S.REAL_ESTATE_CITY_TYPE)
                       & F.year("first_day_exposition").between(lo, hi))


def duration_band(days: str = "days_exposition"):
    """Activity band and its sort key; NULL (still active) is 'active'."""
    d = F.col(days)
    label = (F.when(d <= 30, "1-30 days").when(d <= 90, "31-90 days").when(d <= 180, "91-180 days")
              .when(d >= 181, "181+ days").otherwise("active"))
    order = F.when(d <= 30, 1).when(d <= 90, 2).when(d <= 180, 3).when(d >= 181, 4).otherwise(5)
    return label, order


def listing_activity(spark: SparkSession, sf_dir: str, accuracy: int | None = None) -> DataFrame:
    """17 metrics per (region, duration band), band share inside the region."""
    base = clean_city_listings(spark, sf_dir, accuracy)
    label, order = duration_band()
    area = F.when(F.col("city") == S.REAL_ESTATE_MAIN_CITY, F.lit(S.REAL_ESTATE_MAIN_CITY)).otherwise("other_cities")
    cat = base.select("*", label.alias("category_ads"), order.alias("sort_order"), area.alias("area_name"))

    def med(c):
        return percentile_expr(c, 0.5, "disc", accuracy).cast("bigint").alias(f"median_{c}")

    agg = cat.groupBy("area_name", "category_ads", "sort_order").agg(
        F.count("id").alias("ads_count"),
        numeric_round(F.avg(F.col("last_price") / F.col("total_area")), 2).alias("avg_price_for_metre"),
        numeric_round(F.avg("total_area"), 2).alias("avg_total_area"),
        med("rooms"), med("balcony"),
        numeric_round(F.avg("ceiling_height"), 2).alias("avg_ceiling_height"),
        med("floors_total"), med("floor"),
        numeric_round(F.count_if(F.col("open_plan") == 1) / F.count(F.lit(1)), 2).alias("open_plan_share"),
        med("parks_around3000"), med("ponds_around3000"),
        numeric_round(F.avg("living_area"), 2).alias("avg_living_area"),
        numeric_round(F.count_if(F.col("is_apartment") == 1) / F.count(F.lit(1)), 2).alias("apartment_share"),
        numeric_round(F.avg("kitchen_area"), 2).alias("avg_kitchen_area"),
        numeric_round(F.avg("airports_nearest") / 1000, 2).alias("avg_airports_nearest"),
    )
    # window over the aggregated rows only (at most 2 regions x 5 bands)
    share = numeric_round(F.col("ads_count") / F.sum("ads_count").over(Window.partitionBy("area_name")), 2)
    cols = [c for c in agg.columns if c not in ("sort_order",)]
    cols.insert(cols.index("ads_count") + 1, share.alias("ads_share"))
    return agg.select(*cols, "sort_order").orderBy(F.desc("area_name"), F.asc("sort_order"))


def listing_seasonality(spark: SparkSession, sf_dir: str, accuracy: int | None = None) -> DataFrame:
    """Published vs removed listings per month, shares of all, rank by
    count, average price per metre and area; full join on the month."""
    base = clean_city_listings(spark, sf_dir, accuracy).select(
        "id", "total_area",
        F.month("first_day_exposition").alias("publish_month"),
        month_after_days("first_day_exposition", "days_exposition").alias("removal_month"),
        numeric_round(F.col("last_price") / F.col("total_area"), 2).alias("price_for_metre"))

    def side(month_col: str, prefix: str) -> DataFrame:
        src = base.filter(F.col(month_col).isNotNull()) if prefix == "removed" else base
        agg = src.groupBy(month_col).agg(
            F.count("id").alias(f"{prefix}_ads"),
            numeric_round(F.avg("price_for_metre"), 2).alias(f"{prefix}_avg_price_for_metre"),
            numeric_round(F.avg("total_area"), 2).alias(f"{prefix}_avg_total_area"))
        w_all = Window.partitionBy()  # aggregated rows: at most 13 months
        return agg.select(
            "*",
            numeric_round(F.col(f"{prefix}_ads") / F.sum(f"{prefix}_ads").over(w_all), 2)
            .alias(f"share_of_{prefix}_ads"),
            F.rank().over(Window.orderBy(F.desc(f"{prefix}_ads"))).cast("bigint").alias(f"{prefix}_rank"))

    j = full_outer_on(side("publish_month", "published"), side("removal_month", "removed"),
                      "publish_month", "removal_month", "month")
    return j.select(
        # the month of either side (N22) names the row; both raw months and the
        # counts of a one-sided month are NULL: returned as DOUBLE
        F.col("month").cast("double").alias("month"),
        F.col("publish_month").cast("double").alias("publish_month"),
        F.col("removal_month").cast("double").alias("removal_month"),
        month_name("month").alias("month_name"), season("month").alias("season_name"),
        F.col("published_ads").cast("double").alias("published_ads"), "share_of_published_ads",
        F.col("published_rank").cast("double").alias("published_rank"),
        F.col("removed_ads").cast("double").alias("removed_ads"), "share_of_removed_ads",
        F.col("removed_rank").cast("double").alias("removed_rank"),
        "published_avg_price_for_metre", "removed_avg_price_for_metre",
        "published_avg_total_area", "removed_avg_total_area",
    ).orderBy("month")


def listings_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings, active listings, mean price and price per metre by
    season of publication and number of rooms (dashboard tiles)."""
    lst = S.real_estate_listings(Tables(spark, sf_dir))
    return lst.groupBy(season(F.month("first_day_exposition")).alias("season_name"),
                       F.col("rooms").cast("double").alias("rooms")).agg(
        F.count("id").alias("listings"),
        F.count_if(F.col("days_exposition").isNull()).alias("active_listings"),
        numeric_round(F.avg("last_price"), 2).alias("avg_price"),
        numeric_round(F.avg(safe_div("last_price", "total_area")), 2).alias("avg_price_for_metre"))
