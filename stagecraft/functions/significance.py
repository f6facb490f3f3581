"""Two-sided Student t p-values as a Column expression (no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expansion of gamma(a + 1/2) / (gamma(a) sqrt(a)) in powers of 1/a.
_RATIO = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)
_SHIFT = 30
_TERMS = 60  # enough for full precision at any df


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for df of 1 or more; null or smaller df and null t give NaN.

    This is the regularised incomplete beta function I_x(df/2, 1/2) at x = df/(df + t^2),
    by a continued fraction, from the side on which that converges fast. Small p come
    from the direct side, so they keep their relative accuracy down to the smallest double.
    """
    size, nu = F.abs(t.cast("double")), F.greatest(F.lit(1.0), df.cast("double"))
    a, b = nu / 2, F.lit(0.5)
    scaled = size / F.sqrt(nu)
    square = scaled * scaled
    x, rest = 1 / (1 + square), square / (1 + square)
    # x^a (1-x)^(1/2) / B(a, 1/2)
    front = F.exp(-a * F.log1p(square)) * F.sqrt(rest) * _gamma_ratio(a) / math.sqrt(math.pi)
    p = (F.when(rest > 1.5 / (a + 2.5), front / _fraction(x, rest, a, b))
         .otherwise(1 - front / _fraction(rest, x, b, a)))
    far = (size == math.inf) | (square == math.inf)
    return (F.when(t.isNull() | F.isnan(t) | df.isNull() | (df < 1), F.lit(math.nan))
            .when(far, F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): the expansion at a + _SHIFT, stepped down to a."""
    at = a + _SHIFT
    total = F.lit(0.0)
    for coefficient in reversed(_RATIO):
        total = total / at + coefficient
    down = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(1.0),
                       lambda acc, k: acc * (a + k) / (a + k + 0.5))
    # gamma(a+1/2)/gamma(a) = gamma(a+n+1/2)/gamma(a+n) * prod (a+k)/(a+k+1/2)
    return F.sqrt(at) * total * down


def _fraction(x: Column, rest: Column, a: Column, b: Column) -> Column:
    """The fraction of Didonato and Morris (1992, equation 9) by Lentz's method: given
    ``rest`` = 1 - x, it subtracts no nearly equal numbers."""
    def level(m):
        return (a + m) * (a * rest - b * x + 1 + m * (2 - x)) / (a + 2 * m + 1)

    def step(acc, m):
        at = a + 2 * m - 1
        over = (a + m - 1) * (a + b + m - 1) * m * (b - m) * x * x / (at * at)
        under = m + m * (b - m) * x / at + level(m)
        d, c = 1 / (under + over * acc["d"]), under + over / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["value"] * c * d).alias("value"))

    first = level(F.lit(0))
    start = F.struct(first.alias("c"), F.lit(0.0).alias("d"), first.alias("value"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step,
                       lambda acc: acc["value"])
