"""A/B tests: history metrics, sizing, balance, success and z-tests of the
app recommendation test; the site redesign test; the city reading-time
Welch test (Z27-Z29, X1-X12, A16, A18, A21, A22, F2, F12, J9, J10, U4, W5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import numeric_round
from ..operators.experiments import (attribute_balance, conversion_by_group, events_within, group_balance,
                                     proportions_ztest, sample_size, two_group_counts, users_in_several_groups,
                                     welch_test)
from ..operators.aggregates import with_exact_quantiles
from ..operators.clean import dedupe_keep_first
from ..operators.outliers import rows_of_top_entity
from ..sources import standins as S
from ..sources.tables import Tables

GOOD_PAGES = 4
SESSION_COLS = ("session_id", "session_date", "session_start_ts", "registration_flag", "page_counter",
                "region", "device", "test_group")


def _history(spark, sf_dir) -> DataFrame:
    return S.app_sessions(Tables(spark, sf_dir)).filter(F.col("session_start_ts") < F.lit(S.TEST_START).cast("timestamp_ntz"))


def _test(spark, sf_dir) -> DataFrame:
    return S.app_sessions(Tables(spark, sf_dir)).filter(F.col("session_start_ts") >= F.lit(S.TEST_START).cast("timestamp_ntz"))


def first_sessions(df: DataFrame) -> DataFrame:
    """each user's first session (``session_number == 1``) by start time,
    then session id."""
    return dedupe_keep_first(df.select("user_id", *SESSION_COLS), ["user_id"], ["session_start_ts", "session_id"])


def sessions_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sessions per user, most first."""
    return _history(spark, sf_dir).groupBy("user_id").agg(
        F.count_distinct("session_id").alias("session_count")).orderBy(F.desc("session_count"), "user_id")


def top_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all sessions of the user with the most sessions."""
    h = _history(spark, sf_dir)
    return rows_of_top_entity(h, "user_id", "session_id").select(
        "user_id", "session_id", F.date_format("session_date", "yyyy-MM-dd").alias("session_date"),
        "registration_flag", "page_counter", "region", "device")


def sessions_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: distinct users and registrations per day and their ratio (N12:
    registrations are a sum over sessions, users are distinct)."""
    h = _history(spark, sf_dir)
    d = h.groupBy("session_date").agg(F.count_distinct("user_id").alias("total_users"),
                                      F.sum("registration_flag").alias("registered_users"))
    return d.select(F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), "total_users",
                    "registered_users",
                    numeric_round(F.col("registered_users") / F.col("total_users"), 6).alias("share_registered_users"))


def pages_per_first_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sessions per number of pages viewed."""
    fs = first_sessions(_history(spark, sf_dir))
    return fs.groupBy("page_counter").agg(F.count("session_id").alias("sessions"))


def good_sessions_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sessions per day, good ones (>= 4 pages), share."""
    fs = first_sessions(_history(spark, sf_dir)).withColumn(
        "good_session", (F.col("page_counter") >= GOOD_PAGES).cast("int"))
    d = fs.groupBy("session_date").agg(F.count("good_session").alias("total_sessions"),
                                       F.sum("good_session").alias("good_sessions"))
    return d.select(F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), "total_sessions",
                    "good_sessions",
                    numeric_round(F.col("good_sessions") / F.col("total_sessions"), 6).alias("share_of_good_sessions"))


def _sample_sizes(spark: SparkSession, sf_dir: str, cases) -> DataFrame:
    """Users per group for each (kind, effect, alpha, power) case and
    the test duration from the mean daily users of the history (rounded),
    half of them per group. The base rate is the good-first-session rate."""
    h = _history(spark, sf_dir)
    base = first_sessions(h).agg(F.avg((F.col("page_counter") >= GOOD_PAGES).cast("double")).alias("base_rate"))
    daily = h.groupBy("session_date").agg(F.count_distinct("user_id").alias("u")) \
        .agg(F.round(F.avg("u")).cast("bigint").alias("avg_daily_users"))
    sizes = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("mde_kind"), F.lit(effect).alias("mde"), F.lit(alpha).alias("alpha"),
                 F.lit(power).alias("power"),
                 sample_size(F.col("base_rate"), F.lit(effect), kind == "relative", alpha, power).alias("n"))
        for kind, effect, alpha, power in cases])).alias("s")
    one = base.crossJoin(F.broadcast(daily)).select("base_rate", "avg_daily_users", sizes)
    return one.select("s.mde_kind", numeric_round("base_rate", 6).alias("base_rate"), "s.mde", "s.alpha", "s.power",
                      numeric_round("s.n", 2).alias("sample_size"), "avg_daily_users",
                      F.ceil(F.col("s.n") / (F.col("avg_daily_users") / 2)).cast("bigint").alias("test_duration_days"))


def ab_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 3% relative and a 3-point absolute lift at alpha 0.05, power 0.8."""
    cases = [(kind, 0.03, 0.05, 0.8) for kind in ("relative", "absolute")]
    return _sample_sizes(spark, sf_dir, cases).drop("alpha", "power")


def ab_sample_size_grid(spark: SparkSession, sf_dir: str, alphas=(0.01, 0.05, 0.1), powers=(0.8, 0.9)) -> DataFrame:
    """X11 with alpha and power as inputs: a 3-point lift for each pair."""
    return _sample_sizes(spark, sf_dir, [("absolute", 0.03, a, p) for a in alphas for p in powers])


def ab_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per test group on the test days, percent split."""
    return group_balance(_test(spark, sf_dir), "test_group", "user_id")


def group_pct_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(users A - users B) / users A * 100, conditional distinct counts."""
    t = _test(spark, sf_dir)
    agg = t.agg(F.count_distinct(F.when(F.col("test_group") == "A", F.col("user_id"))).alias("users_a"),
                F.count_distinct(F.when(F.col("test_group") == "B", F.col("user_id"))).alias("users_b"))
    return agg.withColumn("pct_diff", numeric_round((F.col("users_a") - F.col("users_b")) / F.col("users_a") * 100, 4))


def ab_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of users seen in both test groups."""
    both = users_in_several_groups(_test(spark, sf_dir), "test_group", "user_id")
    return both.agg(F.count(F.lit(1)).alias("users_in_both_groups"))


def ab_device_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of each group's users per device of their first test session."""
    return attribute_balance(_test(spark, sf_dir), "user_id", "test_group", "device", "session_start_ts")


def ab_region_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of each group's users per region."""
    return attribute_balance(_test(spark, sf_dir), "user_id", "test_group", "region", "session_start_ts")


def ab_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good-session share of first test sessions per group and B - A in points."""
    fs = first_sessions(_test(spark, sf_dir)).withColumn("good", (F.col("page_counter") >= GOOD_PAGES).cast("int"))
    c = two_group_counts(fs, "test_group", "A", "B", "good")
    return c.select("n_a", "success_a", "n_b", "success_b",
                    numeric_round(F.col("success_a") / F.col("n_a"), 6).alias("share_a"),
                    numeric_round(F.col("success_b") / F.col("n_b"), 6).alias("share_b"),
                    numeric_round((F.col("success_b") / F.col("n_b") - F.col("success_a") / F.col("n_a")) * 100, 4)
                    .alias("diff_points"))


def ab_ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided pooled z-test, H1: good share of A < good share of B."""
    fs = first_sessions(_test(spark, sf_dir)).withColumn("good", (F.col("page_counter") >= GOOD_PAGES).cast("int"))
    return proportions_ztest(two_group_counts(fs, "test_group", "A", "B", "good"), "smaller")


# ------------------------------------------------------------------ site redesign test

def _site_participants(spark, sf_dir) -> DataFrame:
    """Participants of the site test minus users of the competing test."""
    p = S.ab_participants(Tables(spark, sf_dir))
    site = p.filter(F.col("ab_test") == S.SITE_TEST)
    comp = p.filter(F.col("ab_test") == S.COMPETING_TEST).select("user_id")
    return site.join(comp, "user_id", "left_anti")


def site_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the site test, of the competing test, of both, and
    site users left after the exclusion."""
    p = S.ab_participants(Tables(spark, sf_dir))
    flags = p.groupBy("user_id").agg(F.max(F.col("ab_test") == S.SITE_TEST).alias("s"),
                                     F.max(F.col("ab_test") == S.COMPETING_TEST).alias("c"))
    return flags.agg(F.count_if("s").alias("site_users"), F.count_if("c").alias("competing_users"),
                     F.count_if(F.col("s") & F.col("c")).alias("both"),
                     F.count_if(F.col("s") & ~F.col("c")).alias("site_users_clean"))


def site_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per group of the site test after the exclusion."""
    return group_balance(_site_participants(spark, sf_dir), "group", "user_id")


def _site_conversion(spark, sf_dir) -> DataFrame:
    """Events of participants (semi join) within 7 days of
    their first event; buyers flagged; every participant in the denominator."""
    part = _site_participants(spark, sf_dir).select("user_id", "group")
    ev = S.ab_events(Tables(spark, sf_dir)).join(part.select("user_id"), "user_id", "left_semi")
    horizon = events_within(ev, "user_id", "event_dt", 7)
    buyers = horizon.filter(F.col("event_name") == "purchase")
    return conversion_by_group(part, buyers, "user_id", "group")


def site_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _site_conversion(spark, sf_dir)
    return c.select("group", F.col("participants").alias("total_visitors"),
                    F.col("converted").alias("buyers_count"),
                    numeric_round(F.col("conversion") * 100, 2).alias("conversion_rate"))


def site_ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: conversion of A < conversion of B (one-sided, pooled)."""
    c = _site_conversion(spark, sf_dir)
    counts = c.agg(F.sum(F.when(F.col("group") == "A", F.col("participants")).otherwise(0)).alias("n_a"),
                   F.sum(F.when(F.col("group") == "A", F.col("converted")).otherwise(0)).alias("success_a"),
                   F.sum(F.when(F.col("group") == "B", F.col("participants")).otherwise(0)).alias("n_b"),
                   F.sum(F.when(F.col("group") == "B", F.col("converted")).otherwise(0)).alias("success_b"))
    return proportions_ztest(counts, "smaller")


# ------------------------------------------------------------------ reading time by city

def reading_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8/Q10: one row per user id, the first by source order."""
    r = S.reading_activity(Tables(spark, sf_dir))
    return dedupe_keep_first(r, ["puid"], ["source_type"])


def reading_dedupe_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: rows, distinct user ids and duplicates of the reading table."""
    r = S.reading_activity(Tables(spark, sf_dir))
    return r.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("puid").alias("distinct_puid")) \
        .withColumn("duplicates", F.col("rows") - F.col("distinct_puid"))


def reading_city_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: count, mean, median, std, min, max of hours per city (2 digits)."""
    r = reading_clean(spark, sf_dir)
    agg = r.groupBy("city").agg(
        F.count("hours").alias("count"), numeric_round(F.avg("hours"), 2).alias("mean"),
        numeric_round(F.stddev_samp("hours"), 2).alias("std"),
        numeric_round(F.min("hours"), 2).alias("min"), numeric_round(F.max("hours"), 2).alias("max"))
    agg = with_exact_quantiles(agg, r, "hours", [0.5], "city", ["__median"])
    return agg.select("city", "count", "mean", numeric_round("__median", 2).alias("median"), "std", "min", "max")


def welch_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch test, H1: mean hours of city_a > city_b."""
    return welch_test(reading_clean(spark, sf_dir), "city", "hours", "city_a", "city_b", "greater")



