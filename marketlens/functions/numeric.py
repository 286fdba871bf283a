"""Numeric column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_round(c, digits: int) -> Column:
    """``ROUND(x::NUMERIC, n)``: half-up rounding of the decimal value.

    The double is first fixed to 9 decimals (its shortest decimal form for
    ordinary magnitudes), so ties such as 12.345 round up as decimal numbers
    do, independent of the last binary digit or of summation order.
    """
    return F.round(col_(c).cast("decimal(38,9)"), digits).cast("double")


def safe_div(num, den) -> Column:
    """Division that yields NULL for a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def share(num, den, digits: int | None = None) -> Column:
    r = safe_div(num, den)
    return numeric_round(r, digits) if digits is not None else r


def pct_change(new, old, digits: int | None = 1) -> Column:
    """(new - old) / old * 100."""
    r = safe_div(col_(new) - col_(old), old) * 100
    return numeric_round(r, digits) if digits is not None else r


def exact_money_sum(c) -> Column:
    """Sum of money values in exact decimal arithmetic (order independent)."""
    return F.sum(col_(c).cast("decimal(18,2)")).cast("double")
