"""Scalar columns with one missing-value rule: NULL is missing, NaN never leaves a source, and undefined arithmetic is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def ln(x: str | Column) -> Column:
    """Natural logarithm of positive numbers; of others it is NULL by definition."""
    return F.ln(col(x))


def ln1p(x: str | Column) -> Column:
    """ln(1 + x); NULL from -1 downwards."""
    return F.log1p(col(x))


def root(x: str | Column) -> Column:
    return F.when(col(x) >= 0, F.sqrt(col(x)))


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def clip(x: Column, lower: float, upper: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(upper)), F.lit(lower)))


def larger(a: Column, b: Column) -> Column:
    """Maximum that is NULL if either side is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def cents(x: Column) -> Column:
    """Rounded to two decimals, halves to even."""
    return F.rint(x * 100) / 100


def nearest(x: Column, digits: int) -> Column:
    """x rounded to so many decimals, halves away from zero, in doubles.

    Spark's own rounding of doubles goes by their decimal text, which costs more than most formulas in front of it.
    """
    scale = float(10**digits)
    y = x * scale
    r = F.rint(y)
    away = F.when((y - r) * F.signum(y) == 0.5, r + F.signum(y)).otherwise(r)
    return F.when(F.abs(x) < 1e290, away / scale).otherwise(x)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every floating column rounded, zero without a sign: for comparing engines."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[(nearest(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if c in floats else F.col(c) for c in df.columns])
