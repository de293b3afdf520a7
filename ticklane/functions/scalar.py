"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Added to denominators by the book features.
EPSILON = 1e-10


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b in doubles where b may be 0: infinite by the sign of a, NaN for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))


def seconds(ts: Column | str) -> Column:
    """Seconds since 1970 with microseconds, of a timestamp with or without zone."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1e6)


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return (F.unix_micros(col(b).cast("timestamp")) - F.unix_micros(col(a).cast("timestamp"))) / F.lit(1e6)


def at_least_zero_root(x: Column) -> Column:
    """Square root, null for negative numbers."""
    return F.when(x >= 0, F.sqrt(x))


def unbiased_skew(n: Column, skew: Column) -> Column:
    """Bias-corrected skewness from the population one; null under three values."""
    return F.when(n >= 3, divide(F.sqrt(n * (n - 1)), (n - 2).cast("double")) * skew)


def unbiased_kurtosis(n: Column, excess: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; null under four values."""
    return F.when(n >= 4, divide((n - 1).cast("double"), ((n - 2) * (n - 3)).cast("double")) * ((n + 1) * excess + 6))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b): -inf or inf where one of them is 0, NaN where both are, null for negative numbers."""
    r = quotient(a, b)
    return F.when((a >= 0) & (b >= 0), F.when(r == 0, float("-inf")).otherwise(F.ln(r)))


def correlation(x: Column | str, y: Column | str, frame: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows that have both, as an aggregate or over a frame; null without variation (corr itself fails there)."""
    x, y = col(x), col(y)
    over = (lambda c: c.over(frame)) if frame is not None else (lambda c: c)
    both = lambda c: F.when(x.isNotNull() & y.isNotNull(), c)
    return divide(over(F.covar_pop(x, y)), over(F.stddev_pop(both(x))) * over(F.stddev_pop(both(y))))
