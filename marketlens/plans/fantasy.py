"""Fantasy game: paying players, purchases, items and race activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import exact_money_sum, numeric_round, safe_div
from ..operators.aggregates import discrete_percentile
from ..operators.joins import cross_one_row
from ..operators.windows import count_over_partition_distinct
from ..sources import standins as S
from ..sources.tables import Tables


def payer_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total players, paying players, paying share (5 digits).

    Ids are first reduced to one row per id (map-side partial aggregate), so
    both distinct counts come from a single shuffle instead of an Expand.
    """
    users = S.fantasy_users(Tables(spark, sf_dir))
    per_id = users.groupBy("id").agg(F.max(F.col("payer") == 1).alias("is_payer"))
    agg = per_id.agg(F.count("id").alias("total_users"),
                     F.count_if("is_payer").alias("total_paying_users"))
    return agg.select("total_users", "total_paying_users",
                      numeric_round(safe_div("total_paying_users", "total_users"), 5).alias("share_paying_users"))


def payer_share_by_group(spark: SparkSession, sf_dir: str, window_form: bool = False) -> DataFrame:
    """Paying share per race. Races without payers keep NULL counts, as the
    left join of the two counts gives. ``window_form`` runs the COUNT OVER +
    DISTINCT formulation (W1); the default groupBy is one partial aggregate."""
    t = Tables(spark, sf_dir)
    joined = S.fantasy_users(t).join(F.broadcast(S.fantasy_race(t)), "race_id", "inner")
    if window_form:
        total = count_over_partition_distinct(joined, "race", "id", "total_users")
        paying = count_over_partition_distinct(joined.filter(F.col("payer") == 1), "race", "id", "paying_users")
        res = total.join(paying, "race", "left")
    else:
        res = joined.groupBy("race").agg(
            F.count("id").alias("total_users"),
            F.nullif(F.count(F.when(F.col("payer") == 1, F.col("id"))), F.lit(0)).alias("paying_users"))
    return (res.select("race", F.col("paying_users").cast("double").alias("paying_users"), "total_users",
                       numeric_round(safe_div("paying_users", "total_users"), 5)
                       .alias("share_paying_users_in_race_context"))
               .orderBy(F.desc("share_paying_users_in_race_context"), "race"))


def purchase_stats(spark: SparkSession, sf_dir: str, accuracy: int | None = None) -> DataFrame:
    """Z3: count, sum, min, max, mean, discrete median and sample deviation of
    the purchase amount in one global aggregate."""
    e = S.fantasy_events(Tables(spark, sf_dir))
    stats = e.agg(
        F.count("transaction_id").alias("purchase_count"),
        exact_money_sum("amount").alias("total_amount"),
        F.min("amount").alias("min_price"),
        F.max("amount").alias("max_price"),
        numeric_round(F.avg("amount"), 2).alias("avg_price"),
        F.stddev_samp("amount").alias("_sd"),
    )
    med = discrete_percentile(e, "amount", 0.5, accuracy=accuracy).select(
        numeric_round("amount", 2).alias("median"))
    return cross_one_row(stats, med).select(
        "purchase_count", "total_amount", "min_price", "max_price", "avg_price", "median",
        numeric_round("_sd", 2).alias("deviation"))


def zero_amount_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free purchases, all purchases, free share: one conditional aggregate
    replaces the cross join of two one-row counts."""
    e = S.fantasy_events(Tables(spark, sf_dir))
    agg = e.agg(F.count(F.when(F.col("amount") == 0, F.col("transaction_id"))).alias("free_purchases_count"),
                F.count("transaction_id").alias("total_purchases_count"))
    return agg.select("free_purchases_count", "total_purchases_count",
                      numeric_round(safe_div("free_purchases_count", "total_purchases_count"), 5)
                      .alias("share_of_free_purchases"))


def item_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item name, distinct paid sales and the shares of all paid sales
    and of all paying buyers. Sales are counted once per (item, player) - a
    transaction has one player - so no aggregate counts two things distinctly;
    then the rows are made distinct by (name, counts) as the source query does."""
    t = Tables(spark, sf_dir)
    paid = S.fantasy_events(t).filter(F.col("amount") > 0).select(
        "item_code", "transaction_id", F.col("id").alias("player_id"))
    per_player = paid.groupBy("item_code", "player_id").agg(F.count_distinct("transaction_id").alias("n_tx"))
    sales = per_player.groupBy("item_code").agg(
        F.sum("n_tx").alias("total_sales"), F.count("player_id").alias("total_paying_players"))
    totals = cross_one_row(paid.agg(F.count_distinct("transaction_id").alias("all_sales")),
                           per_player.agg(F.count_distinct("player_id").alias("all_players")))
    named = (sales.join(S.fantasy_items(t), "item_code", "inner")
                  .select("game_items", "total_sales", "total_paying_players").distinct())
    return (cross_one_row(named, totals)
            .select("game_items", "total_sales",
                    numeric_round(safe_div("total_sales", "all_sales"), 5).alias("share_of_items_sale"),
                    numeric_round(safe_div("total_paying_players", "all_players"), 5).alias("share_of_players"))
            .orderBy(F.desc("share_of_items_sale"), "game_items", "total_sales"))


def group_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine activity metrics per race.

    Purchases are aggregated per player before the join with players
    (aggregate before join: one row per buyer instead of one per purchase).
    A NULL race keeps its player count but, as in the source's left joins on
    ``race = race``, gets no purchase metrics.
    """
    t = Tables(spark, sf_dir)
    per_player = (S.fantasy_events(t).filter(F.col("amount") > 0)
                  .groupBy("id").agg(F.count("transaction_id").alias("n_tx"),
                                     F.sum(F.col("amount").cast("decimal(18,2)")).alias("amt")))
    users = S.fantasy_users(t).join(F.broadcast(S.fantasy_race(t)), "race_id", "left")
    j = users.join(per_player, "id", "left")
    buyer = F.col("n_tx").isNotNull()
    # one row per (race, player) first: the three distinct counts become plain
    # conditional counts, with no Expand of the rows per distinct column
    per_id = j.groupBy("race", "id").agg(
        F.max(buyer).alias("is_buyer"), F.max(buyer & (F.col("payer") == 1)).alias("is_paying"),
        F.max("n_tx").alias("n_tx"), F.max("amt").alias("amt"))
    agg = per_id.groupBy("race").agg(
        F.count("id").alias("total_users"),
        F.count_if("is_buyer").alias("buying_users"),
        F.count_if("is_paying").alias("paying_users"),
        F.sum("n_tx").alias("total_transaction"),
        F.sum("amt").alias("total_amount"),
    )
    known = F.col("race").isNotNull()
    b = F.when(known, F.nullif("buying_users", F.lit(0)))
    p = F.when(known, F.nullif("paying_users", F.lit(0)))
    tx = F.when(known, F.col("total_transaction"))
    amt = F.when(known, F.col("total_amount"))
    return agg.select(
        # nullable counts are returned as DOUBLE (one numeric type with NULLs
        # on every client)
        "race", "total_users", b.cast("double").alias("buying_users"), p.cast("double").alias("paying_users"),
        numeric_round(safe_div(b, "total_users"), 2).alias("share_buying_users"),
        numeric_round(safe_div(p, b), 2).alias("share_paying_users"),
        numeric_round(safe_div(tx, b), 2).alias("avg_purchase_count"),
        numeric_round(safe_div(amt, tx), 2).alias("avg_purchase_amount"),
        numeric_round(safe_div(amt, b), 2).alias("avg_amount_all_purchases"),
    )
