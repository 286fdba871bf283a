"""Dashboard metrics: food delivery (M1-M6) and conference talks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import numeric_round
from ..operators import bitmaps as B
from ..operators import metrics as M
from ..session import shared_table
from ..sources import standins as S
from ..sources.tables import Tables, inputs


def _food(spark, sf_dir) -> DataFrame:
    return S.food_events(Tables(spark, sf_dir))


def dau(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.dau(_food(spark, sf_dir), "user_id", "ts")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "dau")


def conversion_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.daily_conversion(_food(spark, sf_dir), "user_id", "ts", F.col("event") == "purchase")
    return c.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "active_users", "ordering_users",
                    numeric_round("conversion", 6).alias("conversion"))


def avg_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.average_check(_food(spark, sf_dir), "ts", "revenue", F.col("event") == "purchase")
    return a.select(F.date_format("period", "yyyy-MM").alias("month"), numeric_round("revenue", 2).alias("revenue"),
                    "orders", numeric_round("avg_check", 4).alias("avg_check"))


def ltv_top_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.ltv_top(_food(spark, sf_dir).filter(F.col("event") == "purchase"), "venue", "revenue", 3)
    return t.select("venue", numeric_round("ltv", 2).alias("ltv"))


def ltv_top_dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.ltv_top(_food(spark, sf_dir).filter(F.col("event") == "purchase"), "dish", "revenue", 5)
    return t.select("dish", numeric_round("ltv", 2).alias("ltv"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.retention(_food(spark, sf_dir), "user_id", "ts")
    return r.select("day_offset", "cohort_size", "retained_users", numeric_round("retention_rate", 6).alias("retention_rate"))


def retention_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.retention(_food(spark, sf_dir), "user_id", "ts", cohort="month")
    return r.select("cohort", "day_offset", "cohort_size", "retained_users",
                    numeric_round("retention_rate", 6).alias("retention_rate"))


def _food_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per day as bitmaps, written once for all three reports below."""
    return shared_table(spark, f"food_bitmaps:{sf_dir}", lambda: B.day_bitmaps(_food(spark, sf_dir), "user_id", "ts"),
                        inputs(sf_dir, "events"))


def dau_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 from the bitmaps: distinct users per day, and of the seven days up to it."""
    bits = _food_bitmaps(spark, sf_dir)
    week = bits.select("bucket", "bits", F.explode(F.sequence("day", F.date_add("day", 6))).alias("day")).join(
        bits.select("day").distinct(), "day", "left_semi")
    d = B.dau_of(bits).join(B.users_of(week, ["day"], "wau"), "day")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "dau", "wau")


def retention_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5/M6 from the bitmaps, one common cohort and calendar months."""
    bits = _food_bitmaps(spark, sf_dir)
    r = B.retention_of(bits).unionByName(B.retention_of(bits, "month"))
    return r.select("cohort", "day_offset", "cohort_size", "retained_users",
                    numeric_round("retention_rate", 6).alias("retention_rate"))


def overlap_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2/U3/X2 from bitmaps per event type: viewers and buyers."""
    bits = shared_table(spark, f"event_bitmaps:{sf_dir}",
                        lambda: B.day_bitmaps(_food(spark, sf_dir), "user_id", "ts", ["event"]),
                        inputs(sf_dir, "events"))
    return B.overlap_of(bits, "event", "view", "purchase")


# ------------------------------------------------------------------ conference talks

def _talks(spark, sf_dir) -> DataFrame:
    return S.talks(Tables(spark, sf_dir))


def talk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conferences, talks, distinct speakers, distinct tags."""
    t = _talks(spark, sf_dir)
    head = t.agg(F.count_distinct("conference").alias("conferences"), F.count(F.lit(1)).alias("talks"),
                 F.count_distinct("speaker").alias("speakers"))
    tags = t.select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("tags"))
    return head.crossJoin(tags)


def talk_by_conference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conference: mean length, most views, total applause, speakers."""
    return _talks(spark, sf_dir).groupBy("conference").agg(
        numeric_round(F.avg("length"), 4).alias("mean_length"), F.max("views").alias("max_views"),
        F.sum("applause").alias("total_applause"), F.count_distinct("speaker").alias("speakers"))


def talk_filter(spark: SparkSession, sf_dir: str, country: str = "NATION_3", conference: str = "1-URGENT") -> DataFrame:
    """The selector of the dashboard: talks of one country and conference."""
    t = _talks(spark, sf_dir).filter((F.col("country") == country) & (F.col("conference") == conference))
    return t.agg(F.count(F.lit(1)).alias("talks"), numeric_round(F.sum("views"), 2).alias("views"),
                 F.count_distinct("speaker").alias("speakers"))


def talks_top_laughter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 talks with the most laughter (ties by talk id)."""
    return _talks(spark, sf_dir).select("talk_id", "speaker", "laughter") \
        .orderBy(F.desc("laughter"), "talk_id").limit(10)


def top_tags(spark: SparkSession, sf_dir: str, by: str = "talks") -> DataFrame:
    """20 tags with the most talks (or views, ``by``), with both numbers."""
    t = _talks(spark, sf_dir).select(F.explode("tags").alias("tag"), "talk_id", "views")
    return t.groupBy("tag").agg(F.count("talk_id").alias("talks"), numeric_round(F.sum("views"), 2).alias("views")) \
        .orderBy(F.desc(by), "tag").limit(20)


def speakers_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 speakers with the most applause, with occupation."""
    return _talks(spark, sf_dir).groupBy("speaker", "occupation").agg(F.sum("applause").alias("applause")) \
        .orderBy(F.desc("applause"), "speaker", "occupation").limit(10)
