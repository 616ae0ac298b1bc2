"""Statistics from raw sums, as Columns: the sums may come from windows, aggregates or streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes a part of a formula a column of its own, so that it is written once however often the formula uses it.
Keep = Callable[[str, Column], Column]


def _inline(name: str, part: Column) -> Column:
    return part


def skewness(n: Column, s1: Column, s2: Column, s3: Column, keep: Keep = _inline) -> Column:
    """Population skewness; NULL under three values, 0 where there is no variance."""
    mu = keep("mean", F.try_divide(s1, n))
    m2 = keep("m2", F.try_divide(s2, n) - mu * mu)
    m3 = F.try_divide(s3, n) - 3 * mu * F.try_divide(s2, n) + 2 * mu * mu * mu
    return F.when(n < 3, None).when(m2 < 1e-12, 0.0).otherwise(F.try_divide(m3, F.pow(F.greatest(m2, F.lit(1e-12)), 1.5)))


def adjusted_skewness(n: Column, s1: Column, s2: Column, s3: Column, keep: Keep = _inline) -> Column:
    """Fisher-Pearson skewness adjusted for the sample; 0 under three values or without variance.

    Variance within rounding of the raw sums counts as none, or equal values would give noise over noise.
    """
    mu = keep("mean", F.try_divide(s1, n))
    m2 = keep("square", s2 - s1 * mu)
    m3 = s3 - 3 * mu * s2 + 2 * n * mu * mu * mu
    return F.when(n < 3, 0.0).when(m2 <= F.greatest(F.lit(1e-18), s2 * 1e-13), 0.0).otherwise(F.try_divide(n * F.sqrt(n - 1), n - 2) * F.try_divide(m3, F.pow(F.greatest(m2, F.lit(1e-18)), 1.5)))


def excess_kurtosis(n: Column, s1: Column, s2: Column, s3: Column, s4: Column, keep: Keep = _inline) -> Column:
    """Sample excess kurtosis; NULL under four values, 0 without variance."""
    mu = keep("mean", F.try_divide(s1, n))
    ssd = keep("square", s2 - s1 * mu)
    m4 = s4 - 4 * mu * s3 + 6 * mu * mu * s2 - 3 * n * mu * mu * mu * mu
    a = F.try_divide(n * (n + 1), (n - 1) * (n - 2) * (n - 3))
    b = F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3))
    return F.when(n < 4, None).when(ssd <= 1e-12, 0.0).otherwise(a * F.try_divide(m4 * (n - 1) * (n - 1), ssd * ssd) - b)


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, least: int, keep: Keep = _inline) -> Column:
    """Pearson; NULL under `least` values or where a side does not vary."""
    vx, vy = keep("vx", n * sxx - sx * sx), keep("vy", n * syy - sy * sy)
    ok = (n >= least) & (vx > 1e-12) & (vy > 1e-12)
    return F.when(ok, F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))
