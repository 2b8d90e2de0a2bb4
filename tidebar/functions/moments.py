"""Sample moments with the small-sample corrections."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import c, null


def skew(x) -> Column:
    """Bias-corrected skewness; NULL below three values, 0 for a constant series."""
    v = c(x)
    n = F.count(v).cast("double")
    g = F.skewness(v)
    return F.when(n < 3, null()).when(F.coalesce(F.stddev_pop(v), F.lit(0.0)) == 0.0, 0.0).otherwise(
        g * F.sqrt(n * (n - 1)) / (n - 2)
    )


def excess_kurtosis(x) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values, 0 for a constant series."""
    v = c(x)
    n = F.count(v).cast("double")
    g = F.kurtosis(v)
    return F.when(n < 4, null()).when(F.coalesce(F.stddev_pop(v), F.lit(0.0)) == 0.0, 0.0).otherwise(
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6.0)
    )


def safe_corr(x, y) -> Column:
    """Pearson correlation, NULL when either side is constant."""
    a, b = c(x), c(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(a, b))
