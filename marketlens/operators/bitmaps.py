"""Exact distinct users from bitmaps.

Users are numbered 0, 1, 2, .. exactly, over range partitions. Per group and
day the numbers are bits of bitmaps of 32768 users each, built and united by
Spark's bitmap aggregates. Once they are written, the distinct users of any
days and groups are bit counts of unions and intersections: the events are not
read again, and a year of days of a billion users is some gigabytes a day at
most, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import numeric_round, safe_div
from ..session import write_through
from .windows import numbered


def number_users(df: DataFrame, user: str) -> DataFrame:
    """(user, number): every distinct user that is not NULL, from 0 in order."""
    users = df.select(user).where(F.col(user).isNotNull()).distinct().withColumn("__all", F.lit(0))
    return numbered(users, "__all", [user], "number").select(user, (F.col("number") - 1).alias("number"))


def day_bitmaps(df: DataFrame, user: str, ts: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, day, bucket, bits): the users of each group and day, written
    once. A user's events of a day are one row before anything is joined."""
    days = df.where(F.col(user).isNotNull()).select(user, F.to_date(ts).alias("day"), *groups).distinct()
    days = write_through(days, "user-days")
    rows = days.join(write_through(number_users(days, user), "user-numbers"), user)
    return write_through(rows.groupBy(*groups, "day", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")), "day-bitmaps")


def users_of(bitmaps: DataFrame, by: Sequence[str], out: str = "users") -> DataFrame:
    """Distinct users per ``by`` (columns of ``bitmaps``) over all else."""
    per = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return per.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(out))


def dau_of(bitmaps: DataFrame) -> DataFrame:
    """M1: distinct active users per day."""
    return users_of(bitmaps, ["day"], "dau")


def overlap_of(bitmaps: DataFrame, group: str, a, b) -> DataFrame:
    """Users of group a, of group b, of both, of either, overlap percent."""
    per = bitmaps.where(F.col(group).isin(a, b)).groupBy(group, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    n = F.bitmap_count("bits")
    sides = per.groupBy("bucket").agg(F.sum(F.when(F.col(group) == a, n)).alias("a"), F.sum(F.when(F.col(group) == b, n)).alias("b"),
                                      F.bitmap_count(F.bitmap_or_agg("bits")).alias("any"))
    total = sides.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"users_{c}") for c in ("a", "b", "any")])
    both = F.col("users_a") + F.col("users_b") - F.col("users_any")
    return total.select("users_a", "users_b", both.alias("users_both"), "users_any",
                        numeric_round(safe_div(both, "users_any") * 100, 4).alias("overlap_pct"))


def retention_of(bitmaps: DataFrame, cohort: str | None = None) -> DataFrame:
    """M5/M6: share of the cohort active on each day since its first day, as
    ``metrics.retention``. In a bucket, let P be the union of its days up to d
    and Q that of the days before: the users new on d that are active on e are
    the intersection of P and D(e) less that of Q and D(e). A bucket has one
    row per pair of its days, like the result."""
    day = bitmaps.groupBy("bucket", "day").agg(F.bitmap_or_agg("bits").alias("bits"))
    day = write_through(day, "one-bitmap-a-day")
    in_order = Window.partitionBy("bucket").orderBy("day")  # a bucket has one row per day
    upto = day.select("bucket", F.col("day").alias("d"), F.bitmap_or_agg("bits").over(in_order).alias("p"))
    upto = upto.withColumn("q", F.lag("p").over(Window.partitionBy("bucket").orderBy("d")))
    sides = upto.select("bucket", "d", F.inline(F.array(
        F.struct(F.lit(1).alias("sign"), F.col("p").alias("old")), F.struct(F.lit(-1).alias("sign"), F.col("q").alias("old"))))).where("old is not null")
    pairs = sides.join(day, "bucket").where("d <= day")
    met = pairs.select("bucket", "d", "day", "sign", F.explode(F.array("old", "bits")).alias("x")).groupBy(
        "bucket", "d", "day", "sign").agg(F.bitmap_count(F.bitmap_and_agg("x")).alias("n"))
    # one row per pair of days from here on
    new = write_through(met.groupBy("d", "day").agg(F.sum(F.col("n") * F.col("sign")).alias("n")).where("n > 0"), "met")
    label = F.lit("all") if cohort is None else F.date_format(F.date_trunc(cohort, "d"), "yyyy-MM-dd")
    new = new.select(label.alias("cohort"), F.datediff("day", "d").alias("day_offset"), "n")
    counts = new.groupBy("cohort", "day_offset").agg(F.sum("n").alias("retained_users"))
    sizes = new.groupBy("cohort").agg(F.sum(F.when(F.col("day_offset") == 0, F.col("n"))).alias("cohort_size"),
                                      F.max("day_offset").alias("__max"))
    grid = sizes.select("cohort", "cohort_size", F.explode(F.sequence(F.lit(0), F.col("__max"))).alias("day_offset"))
    j = grid.join(counts, ["cohort", "day_offset"], "left").fillna(0, subset=["retained_users"])
    return j.select("cohort", F.col("day_offset").cast("bigint").alias("day_offset"), "cohort_size", "retained_users",
                    (F.col("retained_users") / F.col("cohort_size")).alias("retention_rate"))

