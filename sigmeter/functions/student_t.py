"""The 0.975 quantile of Student's t, by degrees of freedom.

Up to ``TABLE_DF`` the values come from bisection on the distribution function (computed
once on the driver, 120 numbers); above it the Cornish-Fisher series is exact to
1e-9 and works as a column expression, so any number of groups and sizes is covered.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, functions as F

TABLE_DF = 120
Z975 = 1.959963984540054


def _tail(t: float, df: int) -> float:
    """P(T <= t) for t > 0: finite trigonometric sum of the t distribution."""
    theta = math.atan(t / math.sqrt(df))
    s, c = math.sin(theta), math.cos(theta)
    if df % 2:
        total, term = 0.0, c
        for j in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * (2 * j) / (2 * j + 1)
        area = 2 / math.pi * (theta + s * total)
    else:
        total, term = 0.0, 1.0
        for j in range(1, df // 2 + 1):
            total += term
            term *= c * c * (2 * j - 1) / (2 * j)
        area = s * total
    return 0.5 + area / 2


@lru_cache(maxsize=None)
def t975(df: int) -> float:
    lo, hi = 0.0, 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if _tail(mid, df) < 0.975:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t975_series(df: Column) -> Column:
    z, v = Z975, df.cast("double")
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return F.lit(z) + g1 / v + g2 / (v * v) + g3 / (v * v * v) + g4 / (v * v * v * v)


def t975_col(df: Column) -> Column:
    table = F.array(*[F.lit(t975(i)) for i in range(1, TABLE_DF + 1)])
    return (F.when(df < 1, F.lit(None).cast("double"))
            .when(df <= TABLE_DF, F.get(table, (df - 1).cast("int")))
            .otherwise(t975_series(df)))


def lcb_agg(value: Column) -> Column:
    """Aggregate: mean - t * s / sqrt(n) over non-null values; one value returns itself."""
    n = F.count(value)
    se = F.stddev_samp(value) / F.sqrt(n.cast("double"))
    return F.when(n <= 1, F.avg(value)).otherwise(F.avg(value) - t975_col(n - 1) * se)
