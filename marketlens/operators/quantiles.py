"""Exact percentiles that stay bounded in memory for any group size.

Spark's exact ``percentile`` / ``percentile_disc`` keep a value -> count map
per group and merge a group's maps in one task, so a group with billions of
distinct values (a currency holding a third of all orders) does not fit.
``exact_quantiles`` selects the exact k-th smallest values in two passes:

1. one aggregate per group gives its size and, from a mergeable quantile sketch
   of bounded size, a bracket (lo, hi) around every wanted rank;
2. one aggregate counts the values below, above and at the ends of each bracket
   and the values inside it, by value. The counts are exact, so the k-th value is read off
   the values inside, and it does not matter how good the sketch is.

A bracket holds a few ten-thousandths of a group. Where that may still be more
than ``cap`` distinct values, the second pass only counts, and both passes are
repeated inside the bracket; so they are where a rank lies beside its bracket,
on the side where it lies. Every round divides an open interval, and the values
gathered for one rank stay below the cap, never a whole group. Inputs of every
size take this path; a group under the bound takes the two passes and nothing
else.

The brackets (one row per group) are kept in executor memory between the
passes and recomputed from lineage if an executor is lost; the result, one row
per group, is written to the shared checkpoint folder, and open searches, if
there are any, are written beside it. A NULL group key is a group like any
other. Infinities are values; NaN sorts last. Results equal PostgreSQL / DuckDB
``PERCENTILE_CONT`` and ``PERCENTILE_DISC``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, write_through
from .joins import null_safe_join

ACCURACY = 10_000  # a sketched rank is off by at most n / ACCURACY
CAP = 50_000  # distinct values gathered for one rank
GRID = 256  # sketched ranks of an interval from the second round on
MAX_ROUNDS = 100  # rounds of an interval before the search counts as stuck

BELOW, AT_LO, INSIDE, AT_HI, ABOVE = range(5)


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by=None, kind: str | Sequence[str] = "cont",
                    cap: int = CAP, accuracy: int = ACCURACY, out_prefix: str | None = None) -> DataFrame:
    """Exact percentiles of ``value`` per group: one row per group of ``by``
    with one column per q (named ``{out_prefix or value}_q{i}``). ``kind``
    is 'cont' (interpolated), 'disc' (discrete) or one of them per q. NULL
    values do not count; a group without values has no row. ``df`` is read
    twice: pass a projection of a scan or of a written table."""
    keys = _keys(by)
    ensure_checkpoint_dir(df.sparkSession)
    kinds = [kind] * len(qs) if isinstance(kind, str) else list(kind)
    named = [f"__k{i}" for i in range(len(keys))]  # apart from the names used below
    src = df.select(*[F.col(c).alias(x) for c, x in zip(keys, named)], F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    # wanted 0-based ranks: per q one (discrete) or two (the ends of the interpolation)
    targets: list[tuple[int, int, Column]] = []  # (number, q, rank in a group of n)
    for i, (q, kd) in enumerate(zip(qs, kinds)):
        h = F.lit(float(q)) * (F.col("n") - 1)
        if kd == "cont":
            targets += [(2 * i, i, F.floor(h)), (2 * i + 1, i, F.ceil(h))]
        elif kd == "disc":
            targets.append((2 * i, i, F.greatest(F.ceil(F.lit(float(q)) * F.col("n")) - 1, F.lit(0))))
        else:
            raise ValueError(kd)
    found = _first_round(src, named, qs, targets, cap, accuracy)
    prefix = out_prefix or value
    out = []
    for i, (q, kd) in enumerate(zip(qs, kinds)):
        lo, hi, h = F.col(f"x{2 * i}"), F.col(f"x{2 * i + 1}"), F.lit(float(q)) * (F.col("n") - 1)
        # equal ends first: between two infinities there is no difference
        x = lo if kd == "disc" else F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (h - F.floor(h)))
        out.append(x.alias(f"{prefix}_q{i}"))
    return found.select(*[F.col(x).alias(c) for c, x in zip(keys, named)], *out)


def _cells(rows: DataFrame, by: list[str], intervals: list[tuple[Column, Column, Column]], carry: list[str]) -> DataFrame:
    """The second pass: how many values of ``rows`` (by, __v, carry) lie below,
    inside and above each of ``intervals`` (lo, hi, gather; i is its place), and at
    its ends, inside by value where they are gathered. One row per such cell, in order of value
    with the number of values ``before`` it; NaN has the cell of i = -1. The
    cells of a group meet in one task: five and the gathered ones per interval."""

    def place(i: int, lo: Column, hi: Column, gather: Column) -> Column:
        v = F.col("__v")
        side = F.when(v < lo, BELOW).when(v == lo, AT_LO).when(v > hi, ABOVE).when(v == hi, AT_HI).otherwise(INSIDE)
        return F.struct(F.lit(i).alias("i"), side.alias("side"), F.when((side == INSIDE) & gather, F.col("__v")).alias("w"))

    nan = F.array(F.struct(F.lit(-1).alias("i"), F.lit(ABOVE).alias("side"), F.lit(None).cast("double").alias("w")))
    places = F.array(*[place(i, *x) for i, x in enumerate(intervals)])  # no lambda: it is compiled with the scan
    each = rows.select(*by, *carry, "__v", F.explode(F.when(F.isnan(F.col("__v")), nan).otherwise(places)).alias("x"))
    cells = each.groupBy(*by, F.col("x.i").alias("i"), F.col("x.side").alias("side"), F.col("x.w").alias("w")).agg(
        F.count(F.lit(1)).alias("c"), F.min("__v").alias("mn"), F.max("__v").alias("mx"), *[F.max(c).alias(c) for c in carry])
    cells = cells.repartition(*by) if by else cells.repartition(1)
    order = Window.partitionBy(*by, "i").orderBy("side", "w").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))


def _hit(k: Column) -> Column:
    return (F.col("before") <= k) & (k < F.col("before") + F.col("c"))


def _read_off(k: Column) -> Column:
    """The value of rank ``k`` in the cell that holds it, NULL where the cell
    has several values and ``k`` is neither the first nor the last of them."""
    return (F.when(F.col("mn") == F.col("mx"), F.col("mn")).when(k == F.col("before"), F.col("mn"))
            .when(k == F.col("before") + F.col("c") - 1, F.col("mx")))


def _open(number, k: Column) -> Column:
    return F.struct(F.lit(number).alias("tid") if isinstance(number, int) else number.alias("tid"),
                    (k - F.col("before")).cast("long").alias("k"), F.col("mn").alias("lo"), F.col("mx").alias("hi"))


def _first_round(src: DataFrame, keys: list[str], qs: Sequence[float], targets: list, cap: int, accuracy: int) -> DataFrame:
    """(keys, n, x of every target) of all groups."""
    ends = [F.lit(min(1.0, max(0.0, q + d / accuracy))) for q in qs for d in (-2, 2)]
    real = F.when(~F.isnan(F.col("__v")), F.col("__v"))
    brackets = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(F.col("__v"))).alias("n_nan"), F.percentile_approx(
        real, F.array(*ends), accuracy).alias("b")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        brackets.count()  # its size is known from here on: Spark broadcasts it if it is small
        gather = F.col("n") * 8 / accuracy + 8 <= cap
        intervals = [(F.col("b")[2 * i], F.col("b")[2 * i + 1], gather) for i in range(len(qs))]
        cells = _cells(null_safe_join(src, brackets, keys), keys, intervals, ["n", "n_nan"])
        real_n = F.col("n") - F.col("n_nan")
        values, searches = [], []
        for t, i, k in targets:
            k = k.cast("long")
            here = (F.col("i") == i) & _hit(k)
            values.append(F.max(F.when(k >= real_n, float("nan")).when(here, _read_off(k))).alias(f"x{t}"))
            searches.append(F.when(here & (k < real_n) & _read_off(k).isNull(), _open(t, k)))
        cells = cells.withColumn("s", F.filter(F.array(*searches), lambda x: x.isNotNull()))
        found = cells.groupBy(*keys).agg(F.max("n").alias("n"), *values, F.flatten(F.collect_list("s")).alias("open"))
        seen = Observation()
        found = write_through(found.observe(seen, F.sum(F.size("open")).alias("open")), "quantiles")
    finally:
        brackets.unpersist()
    if not seen.get.get("open"):
        return found
    late = _later_rounds(src, keys, found.select(*keys, F.inline("open")), cap, accuracy)
    late = late.groupBy(*keys).agg(*[F.max(F.when(F.col("tid") == t, F.col("x"))).alias(f"late{t}") for t, _, _ in targets])
    return null_safe_join(found, late, keys, "left").select(
        *keys, "n", *[F.coalesce(f"x{t}", f"late{t}").alias(f"x{t}") for t, _, _ in targets])


def _later_rounds(src: DataFrame, keys: list[str], state: DataFrame, cap: int, accuracy: int) -> DataFrame:
    """(keys, tid, x) of the open searches ``state`` (keys, tid, k, lo, hi):
    rank ``k`` of the values from lo to hi."""
    by, done = [*keys, "tid"], []
    grid = F.array(*[F.lit(g / GRID) for g in range(GRID + 1)])
    for _ in range(MAX_ROUNDS):
        state = write_through(state, "quantile-state")
        rows = null_safe_join(src, state, keys).filter((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))).select(*by, "k", "__v")
        sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"),
                                       F.percentile_approx("__v", grid, accuracy).alias("g"))
        at = F.col("k") / F.col("n") * GRID
        brackets = write_through(sketch.select(
            *by, "n", "k", F.element_at("g", F.greatest(F.floor(at) - 1, F.lit(0)).cast("int") + 1).alias("lo"),
            F.element_at("g", F.least(F.ceil(at) + 2, F.lit(GRID)).cast("int") + 1).alias("hi")), "quantile-state")
        gather = F.col("n") * 8 / GRID <= cap
        cells = _cells(null_safe_join(rows.drop("k"), brackets, by), by, [(F.col("lo"), F.col("hi"), gather)], ["k"])
        k = F.col("k")
        hits = write_through(cells.where(_hit(k)).select(*by, _read_off(k).alias("x"), _open(F.col("tid"), k).alias("s")), "quantile-state")
        done.append(hits.where("x is not null").select(*by, "x"))
        state = hits.where("x is null").select(*keys, "s.*")
        if state.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
    raise RuntimeError("quantile search makes no progress")
