"""Experiment and distribution operators.

Tests are aggregates: Spark computes counts, means and variances per group
in one distributed aggregate, and the statistic, degrees of freedom and
p-value are column expressions on the resulting one-row frame (the CDFs are
native expressions, see ``functions.stats``). Nothing is collected to the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import numeric_round, safe_div
from ..functions.stats import arcsine_effect, normal_cdf, t_sf
from .clean import dedupe_keep_first
from .joins import null_safe_join


def group_balance(df: DataFrame, group: str, user: str) -> DataFrame:
    """Distinct users per group and percent of all distinct users."""
    per = df.groupBy(group).agg(F.count_distinct(user).alias("users"))
    total = per.agg(F.sum("users").alias("__t"))
    return per.crossJoin(F.broadcast(total)).select(
        group, "users", numeric_round(F.col("users") * 100.0 / F.col("__t"), 2).alias("users_pct"))


def users_in_several_groups(df: DataFrame, group: str, user: str) -> DataFrame:
    """Users found in more than one group."""
    return (df.groupBy(user).agg(F.count_distinct(group).alias("n_groups"))
              .filter(F.col("n_groups") > 1))


def overlap_summary(df: DataFrame, group: str, user: str, a, b) -> DataFrame:
    """Users of group a, of group b, of both, of either, overlap percent
    (set intersection and union as per-user flags, one aggregate)."""
    flags = df.groupBy(user).agg(F.max(F.col(group) == F.lit(a)).alias("__a"),
                                 F.max(F.col(group) == F.lit(b)).alias("__b"))
    agg = flags.agg(F.count_if("__a").alias("users_a"), F.count_if("__b").alias("users_b"),
                    F.count_if(F.col("__a") & F.col("__b")).alias("users_both"),
                    F.count_if(F.col("__a") | F.col("__b")).alias("users_any"))
    return agg.withColumn("overlap_pct", numeric_round(safe_div("users_both", "users_any") * 100, 4))


def attribute_balance(df: DataFrame, user: str, group: str, attr: str, order_col: str) -> DataFrame:
    """Each user's first attribute value (A33, by time), then the percent of
    users per attribute value inside each group."""
    first = dedupe_keep_first(df.select(user, group, attr, order_col), [user], [order_col])
    per = first.groupBy(group, attr).agg(F.count(F.lit(1)).alias("users"))
    tot = per.groupBy(group).agg(F.sum("users").alias("__t"))
    return per.join(tot, group).select(group, attr, "users",
                                       numeric_round(F.col("users") * 100.0 / F.col("__t"), 4).alias("users_pct"))


def events_within(df: DataFrame, user: str, ts: str, days: int, start_out: str = "first_ts") -> DataFrame:
    """Events no later than ``days`` after the user's first event (inclusive)."""
    firsts = df.groupBy(user).agg(F.min(ts).alias(start_out))
    j = df.join(firsts, user)
    return j.filter(F.col(ts) - F.col(start_out) <= F.expr(f"INTERVAL {int(days)} DAYS"))


def conversion_by_group(participants: DataFrame, converters: DataFrame, user: str, group: str) -> DataFrame:
    """Converted share per group with every participant in the denominator
    (left join of converter flags, missing = 0)."""
    flags = converters.select(user).distinct().withColumn("__conv", F.lit(1))
    j = participants.join(flags, user, "left").withColumn("__conv", F.coalesce("__conv", F.lit(0)))
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("participants"),
                                F.sum("__conv").alias("converted")).withColumn(
        "conversion", F.col("converted") / F.col("participants"))


def two_group_counts(df: DataFrame, group: str, a, b, success: str) -> DataFrame:
    """One-row frame: n and successes of groups a and b."""
    ga, gb = F.col(group) == F.lit(a), F.col(group) == F.lit(b)
    return df.agg(F.count_if(ga).alias("n_a"), F.sum(F.when(ga, F.col(success)).otherwise(0)).alias("success_a"),
                  F.count_if(gb).alias("n_b"), F.sum(F.when(gb, F.col(success)).otherwise(0)).alias("success_b"))


def proportions_ztest(counts: DataFrame, alternative: str = "smaller", digits: int = 6) -> DataFrame:
    """Pooled two-proportion z-test on a frame with n_a, success_a,
    n_b, success_b; ``smaller`` tests share_a < share_b. Adds the enough-data
    premise (>= 5 successes and failures in both groups)."""
    pa = safe_div("success_a", "n_a")
    pb = safe_div("success_b", "n_b")
    p = safe_div(F.col("success_a") + F.col("success_b"), F.col("n_a") + F.col("n_b"))
    z = safe_div(pa - pb, F.sqrt(p * (1 - p) * (safe_div(F.lit(1.0), "n_a") + safe_div(F.lit(1.0), "n_b"))))
    cdf = normal_cdf(F.col("z"))
    if alternative == "smaller":
        pv = cdf
    elif alternative == "larger":
        pv = F.lit(1.0) - cdf
    else:
        pv = 2 * F.least(cdf, F.lit(1.0) - cdf)
    premise = ((F.col("success_a") >= 5) & (F.col("n_a") - F.col("success_a") >= 5)
               & (F.col("success_b") >= 5) & (F.col("n_b") - F.col("success_b") >= 5))
    return counts.select("*", numeric_round(pa, digits).alias("share_a"), numeric_round(pb, digits).alias("share_b"),
                         z.alias("z"), premise.alias("enough_data")).select(
        *[c for c in counts.columns], "share_a", "share_b", "enough_data",
        numeric_round("z", digits).alias("z_stat"), numeric_round(pv, digits).alias("p_value"))


def welch_from_moments(m: DataFrame, alternative: str = "greater", digits: int = 6) -> DataFrame:
    """Welch t-test on a frame with n_a, mean_a, var_a, n_b, mean_b, var_b
    (sample variances). ``greater`` tests mean_a > mean_b."""
    se2a = safe_div("var_a", "n_a")
    se2b = safe_div("var_b", "n_b")
    t = safe_div(F.col("mean_a") - F.col("mean_b"), F.sqrt(se2a + se2b))
    dof = safe_div((se2a + se2b) ** 2, safe_div(se2a ** 2, F.col("n_a") - 1) + safe_div(se2b ** 2, F.col("n_b") - 1))
    base = m.select("*", t.alias("__t"), dof.alias("__df"))
    upper = t_sf(F.col("__t"), F.col("__df"))
    pv = {"greater": upper, "less": F.lit(1.0) - upper,
          "two-sided": 2 * F.least(upper, F.lit(1.0) - upper)}[alternative]
    return base.select(*m.columns, numeric_round("__t", digits).alias("t_stat"),
                       numeric_round("__df", digits).alias("dof"),
                       numeric_round(pv, digits).alias("p_value"))


def welch_test(df: DataFrame, group: str, value: str, a, b, alternative: str = "greater",
               digits: int = 6) -> DataFrame:
    """X10 from rows: one aggregate of count / mean / sample variance per side."""
    ga, gb = F.col(group) == F.lit(a), F.col(group) == F.lit(b)
    va, vb = F.when(ga, F.col(value)), F.when(gb, F.col(value))
    m = df.agg(F.count(va).alias("n_a"), F.avg(va).alias("mean_a"), F.var_samp(va).alias("var_a"),
               F.count(vb).alias("n_b"), F.avg(vb).alias("mean_b"), F.var_samp(vb).alias("var_b"))
    out = welch_from_moments(m, alternative, digits)
    return out.select("n_a", numeric_round("mean_a", digits).alias("mean_a"),
                      numeric_round("var_a", digits).alias("var_a"), "n_b",
                      numeric_round("mean_b", digits).alias("mean_b"),
                      numeric_round("var_b", digits).alias("var_b"), "t_stat", "dof", "p_value")


def sample_size(base_rate: Column, effect: Column, relative: bool = True,
                alpha: float = 0.05, power: float = 0.8) -> Column:
    """X11: users per group to detect ``effect`` on a proportion (arcsine effect
    size, two-sided ``alpha``, equal groups): 2 * ((z_a + z_b) / h)^2 with the
    normal quantiles of 1 - alpha / 2 and of the power. With ``relative`` the
    effect is a share of the base rate (N15)."""
    z = NormalDist().inv_cdf
    target = base_rate * (1 + effect) if relative else base_rate + effect
    h = arcsine_effect(target, base_rate)
    return 2 * (F.lit(z(1 - alpha / 2) + z(power)) / h) ** 2


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins between min and max, empty ones included (count
    0); the last bin is closed on the right (numpy). Bounds come from a one-row
    aggregate; counts are a partial aggregate by bin index."""
    keys = [by] if by else []
    src = df.filter(F.col(value).isNotNull())
    rng = src.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    if not keys:
        rng = rng.filter(F.col("__lo").isNotNull())
    # one range row per group: broadcast only the single global row; per-group
    # ranges grow with the number of groups and are left to AQE
    j = null_safe_join(src, rng, keys) if keys else src.crossJoin(F.broadcast(rng))
    width = (F.col("__hi") - F.col("__lo")) / bins
    idx = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1))).cast("int")
    counts = j.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = null_safe_join(every, counts, [*keys, "bin"], "left")
    return out.select(*keys, "bin", (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins)
                      .alias("bin_left"),
                      (F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins)
                      .alias("bin_right"), F.coalesce("count", F.lit(0)).alias("count"))


def boxplot_stats(df: DataFrame, value: str, by: str | None = None, whisker: float = 1.5,
                  accuracy: int | None = None) -> DataFrame:
    """Quartiles, whiskers (most extreme values inside 1.5 IQR) and the
    number of outliers, per group."""
    keys = [by] if by else []
    src = df.filter(F.col(value).isNotNull())
    for k in keys:
        src = src.filter(F.col(k).isNotNull())
    if accuracy is None:
        from .quantiles import exact_quantiles
        q = exact_quantiles(src, value, [0.25, 0.5, 0.75], by=keys, out_prefix="__b").select(
            *keys, F.col("__b_q0").alias("q1"), F.col("__b_q1").alias("median"), F.col("__b_q2").alias("q3"))
    else:
        qs = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
        q = src.groupBy(*keys).agg(qs.alias("__q")).select(
            *keys, F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q3"))
    j = src.join(q, keys, "inner") if keys else src.crossJoin(F.broadcast(q))
    lo = F.col("q1") - whisker * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + whisker * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_low"),
        F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count_if((v < lo) | (v > hi)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per (a, b) pair, NULL pairs dropped."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"))


def chi_square_association(df: DataFrame, target: str, attrs: Sequence[str]) -> DataFrame:
    """X13 (chi-square part): for each attribute, Pearson chi-square against
    the target and Cramer's V, computed from the contingency table in SQL
    expressions. Attributes are unpivoted so one aggregate covers all of
    them."""
    long = df.select(F.col(target).cast("string").alias("__t"),
                     F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("val"))
                                         for a in attrs])).alias("__p")) \
        .select("__t", F.col("__p.attr").alias("attr"), F.col("__p.val").alias("val")) \
        .filter(F.col("__t").isNotNull() & F.col("val").isNotNull())
    cells = long.groupBy("attr", "__t", "val").agg(F.count(F.lit(1)).alias("n"))
    row_tot = cells.groupBy("attr", "__t").agg(F.sum("n").alias("n_t"))
    col_tot = cells.groupBy("attr", "val").agg(F.sum("n").alias("n_v"))
    all_tot = cells.groupBy("attr").agg(F.sum("n").alias("n_all"),
                                        F.count_distinct("__t").alias("k_t"),
                                        F.count_distinct("val").alias("k_v"))
    # sum((o - e)^2 / e) over all cells = n * (sum(o^2 / (r * c)) - 1), and cells
    # that were not observed add nothing to the right side: no grid of all pairs
    seen = cells.join(row_tot, ["attr", "__t"]).join(col_tot, ["attr", "val"])
    part = seen.groupBy("attr").agg(F.sum(F.col("n") * F.col("n").cast("double") / (
        F.col("n_t").cast("double") * F.col("n_v"))).alias("__s"))
    chi = part.join(all_tot, "attr").withColumn("chi2", F.greatest(F.col("n_all") * (F.col("__s") - 1), F.lit(0.0)))
    v = F.sqrt(safe_div("chi2", F.col("n_all") * (F.least("k_t", "k_v") - 1)))
    return chi.select("attr", "n_all", numeric_round("chi2", 6).alias("chi2"),
                      numeric_round(v, 6).alias("cramers_v")).orderBy(F.desc("cramers_v"), "attr")

