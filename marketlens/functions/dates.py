"""Calendar helpers: seasons, weekday names, month names, day offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_

# Meteorological seasons by month number, as used by the analyses.
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}

# Weekday labels, Monday = 0.
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def season(month_col) -> Column:
    m = col_(month_col)
    expr = None
    for name, months in SEASON_MONTHS.items():
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def weekday0(ts) -> Column:
    """Weekday number with Monday = 0 (``Series.dt.weekday``)."""
    return F.weekday(col_(ts))


def weekday_name(ts) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), weekday0(ts) + 1)


def day_type(ts) -> Column:
    return F.when(weekday0(ts) >= 5, F.lit("weekend")).otherwise(F.lit("weekday"))


def month_name(month_col) -> Column:
    """``TO_CHAR(MAKE_DATE(2023, m, 1), 'Month')`` without the blank padding."""
    return F.date_format(F.make_date(F.lit(2023), col_(month_col).cast("int"), F.lit(1)), "MMMM")


def month_after_days(ts, days) -> Column:
    """``EXTRACT(MONTH FROM ts + INTERVAL '1 day' * n)``; NULL n gives NULL."""
    return F.month(F.date_add(F.to_date(col_(ts)), col_(days).cast("int")))

