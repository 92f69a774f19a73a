"""Column expressions: rounding and tails of distributions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BETA = "org.apache.commons.math3.special.Beta"
_ERF = "org.apache.commons.math3.special.Erf"


def rounded(x: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value."""
    scale = F.lit(10.0**digits)
    return F.rint(x * scale) / scale


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null where t is null or NaN.

    ``reflect`` counts as non-deterministic: use the result in a projection of its own.
    """
    x = df / (df + t * t)
    p = F.reflect(F.lit(_BETA), F.lit("regularizedBeta"), x.cast("double"), (df / 2).cast("double"), F.lit(0.5)).cast("double")
    return F.when(t.isNotNull() & ~F.isnan(t), p)


def chi2_of_pvalue(p: Column) -> Column:
    """Upper quantile of chi-square with one degree of freedom."""
    z = F.reflect(F.lit(_ERF), F.lit("erfInv"), (F.lit(1.0) - p).cast("double")).cast("double")
    return F.lit(2.0) * z * z


def minus_log10(p: Column) -> Column:
    """-log10 of valid p-values, 0 of others."""
    return F.when((p > 0) & (p <= 1), -F.log10(p)).otherwise(F.lit(0.0))
