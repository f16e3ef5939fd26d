"""Null-safe ratios, hash-keyed uniforms and small scalar helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

TWO_52 = float(2**52)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num/den as double; a zero or null denominator gives null, never infinity."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def r9(c: Column | str) -> Column:
    return F.round(col(c), 9)


def safe_log(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


def key_hex(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def hex01(hexed: Column, start: int = 1) -> Column:
    """13 hex digits as a uniform in [0,1): exact in a double."""
    return F.conv(F.substring(hexed, start, 13), 16, 10).cast("long").cast("double") / F.lit(TWO_52)


def hash13(*parts: Column | str | int) -> Column:
    """The digits of ``hash01``: in the order of its numbers, without making them."""
    return F.substring(key_hex(*parts), 1, 13)


def hash01(*parts: Column | str | int) -> Column:
    """Uniform in [0,1) keyed by the parts, so any partitioning draws the same number."""
    return hex01(key_hex(*parts))


def uniform64(key: Column) -> Column:
    """First 64 bits of sha256 over 2^64: the uniform that planted labels are keyed by."""
    hexed = F.sha2(key, 256)
    hi = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double")
    lo = F.conv(F.substring(hexed, 9, 8), 16, 10).cast("double")
    return (hi * F.lit(4294967296.0) + lo) / F.lit(18446744073709551616.0)


def text_flag(c: Column) -> Column:
    """Text to boolean; accepted spellings are fixed values."""
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes", "y")


def harmonic(n: Column) -> Column:
    """n-th harmonic number for n >= 0: exact sum below 32, asymptotic series above."""
    x = n.cast("double")
    small = [0.0]
    for i in range(1, 32):
        small.append(small[-1] + 1.0 / i)
    table = F.array(*[F.lit(v) for v in small])
    series = (F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x)
              + 1 / (120 * x * x * x * x))
    return F.when(n < 32, F.get(table, n.cast("int"))).otherwise(series)


def harmonic_series(x: np.ndarray) -> np.ndarray:
    """Harmonic numbers of 32 or more, also between the integers."""
    return np.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def harmonic_numbers(n: np.ndarray) -> np.ndarray:
    """As ``harmonic``, over an array."""
    small = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 32))])
    return np.where(n < 32, small[np.minimum(n, 31)], harmonic_series(np.maximum(n, 1).astype(float)))
