"""Distribution functions as native Spark column expressions.

Spark SQL has no normal or Student-t CDF. Both are computed by composite
Simpson quadrature written with ``aggregate(sequence(0, N), ...)``, so they
stay inside the JVM and evaluate on the one-row (or per-group) aggregate of
a test; no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_

# Simpson panels, and the truncation of the t integral at
# 40 standard deviations of the transformed density.
SIMPSON_STEPS = 2000
T_TRUNCATION = 40.0


def _simpson(upper: Column, integrand) -> Column:
    """Integral of ``integrand(x)`` over [0, upper] with SIMPSON_STEPS panels."""
    n = SIMPSON_STEPS
    h = upper / F.lit(float(n))

    def step(acc, i):
        w = F.when((i == 0) | (i == n), F.lit(1.0)).when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
        return acc + w * integrand(i.cast("double") * h)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), step)
    return total * h / F.lit(3.0)


def normal_cdf(z) -> Column:
    """Standard normal CDF."""
    z = col_(z).cast("double")
    half_mass = _simpson(F.abs(z), lambda x: F.exp(-x * x / 2.0)) / F.lit(math.sqrt(2 * math.pi))
    return F.when(z.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(z >= 0, F.lit(0.5) + half_mass).otherwise(F.lit(0.5) - half_mass))


def t_sf(t, df) -> Column:
    """Upper tail P(T > t) of Student's t with ``df`` degrees of freedom.

    With t = sqrt(df) tan(theta) the density becomes proportional to
    cos(theta)^(df-1), so no gamma function is needed.
    """
    t = col_(t).cast("double")
    df = col_(df).cast("double")
    bound = F.least(F.lit(math.pi / 2), F.lit(T_TRUNCATION) / F.sqrt(df))
    angle = F.least(F.atan(F.abs(t) / F.sqrt(df)), bound)
    dens = lambda x: F.pow(F.cos(x), df - 1.0)
    tail = F.greatest(F.lit(0.0), (F.lit(1.0) - _simpson(angle, dens) / _simpson(bound, dens)) / 2.0)
    return F.when(t.isNull() | df.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(t >= 0, tail).otherwise(F.lit(1.0) - tail))


def arcsine_effect(p1, p2) -> Column:
    """Cohen's h for two proportions."""
    return F.abs(2 * F.asin(F.sqrt(col_(p1))) - 2 * F.asin(F.sqrt(col_(p2))))
