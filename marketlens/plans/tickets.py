"""Ticket sales: cleaning, season comparisons, daily dynamics, leaderboards,
device tests (Z9-Z14, A14, U2-U3, W6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_type, season, weekday0, weekday_name
from ..functions.numeric import numeric_round, pct_change, safe_div
from ..operators.aggregates import with_exact_quantiles
from ..operators.clean import dedupe_keep_first
from ..operators.experiments import overlap_summary, welch_test
from ..operators.joins import heavy_keys, join_unique
from ..operators.outliers import cap_by_group_percentile, group_caps
from ..operators.windows import days_since_previous
from ..session import DENSE, shared_metrics, shared_table, write_through
from ..sources import standins as S
from ..sources.tables import Tables, inputs

# The key columns of the duplicate check of ticket orders.
TICKET_DUP_SUBSET = ("user_id", "event_id", "created_ts_msk", "tickets_count", "revenue",
                     "currency_code", "event_type_description", "event_type_main")
CURRENCIES = ("rub", "kzt")


def _tickets_shared(reader, spark: SparkSession, sf_dir: str, accuracy: int | None) -> DataFrame:
    return reader(spark, f"tickets_clean:{sf_dir}:{accuracy}", lambda: build_tickets_clean(spark, sf_dir, accuracy),
                  inputs(sf_dir, "lineitem", "orders", "part"))


def tickets_clean(spark: SparkSession, sf_dir: str, accuracy: int | None = None) -> DataFrame:
    """Z9, the cleaned ticket orders shared by all ticket reports (written
    once per application and state of its inputs, see ``session.shared_table``)."""
    return _tickets_shared(shared_table, spark, sf_dir, accuracy)


def cleaning_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before, removed by the p99 cap, removed as duplicates,
    after, percent removed, and orders in a foreign currency on a day without a
    rate: observed by the run that cleaned the orders, none is read again."""
    m = _tickets_shared(shared_metrics, spark, sf_dir, None)
    return m.select(
        "rows_before", (F.col("rows_before") - F.col("rows_capped")).alias("removed_cap"),
        (F.col("rows_capped") - F.col("rows_after")).alias("removed_duplicates"), "rows_after",
        numeric_round((F.col("rows_before") - F.col("rows_after")) * 100.0 / F.nullif("rows_before", F.lit(0)), 4).alias("removed_pct"),
        "unmatched_rates")


def build_tickets_clean(spark: SparkSession, sf_dir: str, accuracy: int | None = None) -> tuple[DataFrame, list]:
    """p99 revenue cap per currency, duplicate removal (first by order id),
    daily rate join, revenue in roubles, revenue per ticket, month, season,
    days since the user's previous order; and the metrics of the audit."""
    t = Tables(spark, sf_dir)
    # the joined orders are written once; caps, filter and duplicates are scans of them
    seen = Observation()
    raw = write_through(S.ticket_orders(t).filter(F.col("currency_code").isin(*CURRENCIES)).observe(
        seen, F.count(F.lit(1)).alias("rows")), "ticket-orders", DENSE)
    capped = cap_by_group_percentile(raw, "revenue", "currency_code", 0.99, CURRENCIES, accuracy)
    n_capped = capped.count()  # two columns of the written orders
    dedup = dedupe_keep_first(capped, TICKET_DUP_SUBSET, ["order_id"], rare=True)
    # the previous order before the rates and what follows from them: its rows move narrow.
    # after the dedupe these columns identify a row within a user: a total order
    gaps = days_since_previous(dedup, "user_id", "created_ts_msk",
                               ["order_id", "event_id", "tickets_count", "revenue", "event_type_description"],
                               hot=heavy_keys(raw, ["user_id"]))
    # a row per day, written: its size is known, so no order moves to meet it
    rates = write_through(S.tenge_rates(t), "rates")
    j = join_unique(gaps, rates, "created_dt_msk", "data", "curs")
    rub = F.when(F.col("currency_code") == "rub", F.col("revenue")).otherwise(
        F.col("revenue") * F.col("curs") / 100)
    feat = j.select("*", rub.alias("revenue_rub")).select(
        "*", (F.col("revenue_rub") / F.col("tickets_count")).alias("one_ticket_revenue_rub"),
        F.month("created_dt_msk").alias("month"), season(F.month("created_dt_msk")).alias("season"))
    done = feat.select(*[c for c in feat.columns if c != "days_since_prev"], "days_since_prev")
    return done, [F.coalesce(F.max(F.lit(seen.get["rows"])), F.lit(seen.get["rows"])).cast("long").alias("rows_before"),
                  F.coalesce(F.max(F.lit(n_capped)), F.lit(n_capped)).cast("long").alias("rows_capped"),
                  F.count(F.lit(1)).alias("rows_after"),
                  F.count_if((F.col("currency_code") != "rub") & F.col("curs").isNull()).alias("unmatched_rates")]


def revenue_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 report: the p99 revenue cap of each currency and the orders kept and
    cut by it (the printed caps and cut count of the cleaning step)."""
    raw = S.ticket_orders(Tables(spark, sf_dir)).filter(F.col("currency_code").isin(*CURRENCIES)).select("currency_code", "revenue")
    caps = group_caps(raw, "revenue", "currency_code", 0.99)
    j = raw.join(caps, "currency_code")
    return j.groupBy("currency_code", "cap").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("revenue") <= F.col("cap")).alias("kept"),
        F.count_if(F.col("revenue") > F.col("cap")).alias("cut")).select(
        "currency_code", numeric_round("cap", 2).alias("cap"), "orders", "kept", "cut")


def _rounded(df: DataFrame, cols, digits=6) -> DataFrame:
    return df.select(*[numeric_round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def season_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of summer and of autumn orders per event type, device and
    age limit (value_counts(normalize) of each season, outer-joined). One
    aggregate over the three dimensions in long form; a value seen in one
    season only has NULL for the other."""
    tc = tickets_clean(spark, sf_dir).filter(F.col("season").isin("summer", "autumn"))
    dims = F.explode(F.array(
        F.struct(F.lit("event_type").alias("dimension"), F.col("event_type_main").cast("string").alias("value")),
        F.struct(F.lit("device").alias("dimension"), F.col("device_type_canonical").alias("value")),
        F.struct(F.lit("age_limit").alias("dimension"), F.col("age_limit").cast("string").alias("value"))))
    long = tc.select("season", dims.alias("d")).select("season", "d.dimension", "d.value")
    per = long.groupBy("dimension", "value").agg(
        F.count_if(F.col("season") == "summer").alias("n_summer"),
        F.count_if(F.col("season") == "autumn").alias("n_autumn"))
    tot = tc.agg(F.count_if(F.col("season") == "summer").alias("t_summer"),
                 F.count_if(F.col("season") == "autumn").alias("t_autumn"))
    j = per.crossJoin(F.broadcast(tot))
    return j.select("dimension", "value",
                    numeric_round(safe_div(F.nullif("n_summer", F.lit(0)) * 100, "t_summer"), 6).alias("summer_share"),
                    numeric_round(safe_div(F.nullif("n_autumn", F.lit(0)) * 100, "t_autumn"), 6).alias("autumn_share"))


def season_unit_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean revenue per ticket by event type in summer and autumn and the
    percent change (1 digit)."""
    tc = tickets_clean(spark, sf_dir)
    v = F.col("one_ticket_revenue_rub")
    agg = tc.groupBy(F.col("event_type_main").alias("event_type")).agg(
        F.avg(F.when(F.col("season") == "summer", v)).alias("summer_mean"),
        F.avg(F.when(F.col("season") == "autumn", v)).alias("autumn_mean"))
    agg = agg.filter(F.col("summer_mean").isNotNull() | F.col("autumn_mean").isNotNull())
    return agg.select("event_type", numeric_round("summer_mean", 6).alias("summer_mean"),
                      numeric_round("autumn_mean", 6).alias("autumn_mean"),
                      pct_change("autumn_mean", "summer_mean", 1).alias("change_percent")) \
        .orderBy(F.desc("summer_mean"), "event_type")


def _autumn_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    tc = tickets_clean(spark, sf_dir).filter(F.col("season") == "autumn")
    return tc.groupBy("created_dt_msk").agg(
        F.count("order_id").alias("orders_count"),
        F.count_distinct("user_id").alias("dau"),
        F.avg("one_ticket_revenue_rub").alias("avg_ticket_price"))


def daily_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per autumn day: orders, DAU, mean ticket price, orders per user,
    weekday (Monday = 0), weekday name and day type."""
    d = _autumn_daily(spark, sf_dir)
    return d.select(F.date_format("created_dt_msk", "yyyy-MM-dd").alias("day"), "orders_count", "dau",
                    numeric_round("avg_ticket_price", 6).alias("avg_ticket_price"),
                    numeric_round(F.col("orders_count") / F.col("dau"), 6).alias("avg_orders_per_user"),
                    weekday0("created_dt_msk").cast("bigint").alias("day_of_week"),
                    weekday_name("created_dt_msk").alias("weekday_name"),
                    day_type("created_dt_msk").alias("type_of_day"))


def weekday_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per weekday, the mean of the daily orders and DAU (2 digits)."""
    d = _autumn_daily(spark, sf_dir)
    return d.groupBy(weekday0("created_dt_msk").cast("bigint").alias("day_of_week")).agg(
        F.min(weekday_name("created_dt_msk")).alias("weekday_name"),
        numeric_round(F.avg("orders_count"), 2).alias("avg_orders"),
        numeric_round(F.avg("dau"), 2).alias("avg_dau")).orderBy("day_of_week")


def day_type_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday vs weekend means of the daily orders and DAU."""
    d = _autumn_daily(spark, sf_dir)
    return d.groupBy(day_type("created_dt_msk").alias("type_of_day")).agg(
        numeric_round(F.avg("orders_count"), 2).alias("avg_orders"),
        numeric_round(F.avg("dau"), 2).alias("avg_dau"))


def _leader_stats(tc: DataFrame, key: str, with_revenue: bool) -> DataFrame:
    aggs = [F.count_distinct("event_id").alias("events_count"), F.count("order_id").alias("orders_count")]
    if with_revenue:
        aggs.append(F.sum("revenue_rub").alias("ticket_revenue"))
    per = tc.groupBy(key).agg(*aggs)
    tot_aggs = [F.count_distinct("event_id").alias("__te"), F.count(F.lit(1)).alias("__to")]
    if with_revenue:
        tot_aggs.append(F.sum("revenue_rub").alias("__tr"))
    tot = tc.agg(*tot_aggs)
    cols = [key, "events_count", "orders_count",
            numeric_round(F.col("events_count") / F.col("__te") * 100, 2).alias("events_share"),
            numeric_round(F.col("orders_count") / F.col("__to") * 100, 2).alias("orders_share")]
    if with_revenue:
        cols += [numeric_round("ticket_revenue", 2).alias("ticket_revenue"),
                 numeric_round(F.col("ticket_revenue") / F.col("__tr") * 100, 2).alias("revenue_share")]
    return per.crossJoin(F.broadcast(tot)).select(*cols)


def region_leaderboard(spark: SparkSession, sf_dir: str, by: str = "events_count", k: int = 5) -> DataFrame:
    """Regions by distinct events (or orders), shares of the totals, top 5."""
    s = _leader_stats(tickets_clean(spark, sf_dir), "region_name", False)
    return s.orderBy(F.desc(by), "region_name").limit(k)


def partner_leaderboard(spark: SparkSession, sf_dir: str, by: str = "ticket_revenue", k: int = 5) -> DataFrame:
    """Ticket partners by events, orders or revenue, with shares, top 5."""
    s = _leader_stats(tickets_clean(spark, sf_dir), "service_name", True)
    return s.orderBy(F.desc(by), "service_name").limit(k)


def first_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the first and the last month present, percent change."""
    tc = tickets_clean(spark, sf_dir)
    m = tc.groupBy("month").agg(F.count("order_id").alias("order_count"))
    agg = m.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"),
                F.min_by("order_count", "month").alias("first_count"),
                F.max_by("order_count", "month").alias("last_count"))
    return agg.select(F.col("first_month").cast("bigint").alias("first_month"),
                      F.col("last_month").cast("bigint").alias("last_month"), "first_count", "last_count",
                      pct_change("last_count", "first_count", 2).alias("change_percent"))


def overlap_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autumn users on mobile, on desktop, on both, on either, percent on both."""
    tc = tickets_clean(spark, sf_dir).filter(F.col("season") == "autumn")
    return overlap_summary(tc, "device_type_canonical", "user_id", "mobile", "desktop")


def welch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per (user, device) in autumn; Welch test that mobile
    users order more than desktop users (one-sided)."""
    tc = tickets_clean(spark, sf_dir).filter(F.col("season") == "autumn")
    per = tc.groupBy("user_id", F.col("device_type_canonical").alias("device")).agg(
        F.count("order_id").alias("orders_count"))
    return welch_test(per, "device", "orders_count", "mobile", "desktop", "greater")


def welch_order_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean days between orders per user and device in autumn;
    Welch test that the mobile gap is longer."""
    tc = tickets_clean(spark, sf_dir).filter((F.col("season") == "autumn") & F.col("days_since_prev").isNotNull())
    per = tc.groupBy("user_id", F.col("device_type_canonical").alias("device")).agg(
        F.avg("days_since_prev").alias("gap"))
    return welch_test(per, "device", "gap", "mobile", "desktop", "greater")


def order_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per device, distribution of the users' mean gap between orders."""
    tc = tickets_clean(spark, sf_dir).filter(F.col("days_since_prev").isNotNull())
    per = tc.groupBy("user_id", F.col("device_type_canonical").alias("device")).agg(
        F.avg("days_since_prev").alias("gap"))
    agg = per.groupBy("device").agg(F.count("gap").alias("users"), F.avg("gap").alias("mean_gap"),
                                    F.stddev_samp("gap").alias("std_gap"), F.min("gap").alias("min_gap"),
                                    F.max("gap").alias("max_gap"))
    agg = with_exact_quantiles(agg, per, "gap", [0.5], "device", ["median_gap"])
    return _rounded(agg, {"mean_gap", "std_gap", "min_gap", "median_gap", "max_gap"})


def tickets_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z9 as a registered query: the cleaned orders, dates as ISO text."""
    tc = tickets_clean(spark, sf_dir)
    return tc.select(
        "order_id", "user_id", F.date_format("created_dt_msk", "yyyy-MM-dd").alias("created_dt_msk"),
        F.date_format("created_ts_msk", "yyyy-MM-dd HH:mm:ss").alias("created_ts_msk"),
        "event_id", "currency_code", "device_type_canonical", "revenue", "tickets_count",
        "event_type_main", "region_name", "service_name", "curs",
        numeric_round("revenue_rub", 6).alias("revenue_rub"),
        numeric_round("one_ticket_revenue_rub", 6).alias("one_ticket_revenue_rub"),
        F.col("month").cast("bigint").alias("month"), "season",
        F.col("days_since_prev").cast("double").alias("days_since_prev"))  # NULL on first orders
