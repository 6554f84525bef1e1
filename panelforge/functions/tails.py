"""Tails of the normal and chi-square laws as Columns, with small relative errors far out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this the series, above it the continued fraction; both are good to about 1e-15 there.
_SPLIT, _TERMS, _LEVELS = 2.0, 44, 60


def erfc(x: Column) -> Column:
    """Complementary error function.

    Up to 2 one less the series exp(-x^2) (x + 2/3 x^3 + 4/15 x^5 + ...), whose
    terms are all positive; beyond it the continued fraction, so that small values
    keep their digits. Negative x by symmetry.
    """
    a, square = F.abs(x), x * x
    down = lambda n: F.sequence(F.lit(n), F.lit(1))
    near = F.aggregate(down(_TERMS), F.lit(1.0), lambda acc, k: 1.0 + acc * square * (2.0 / (2 * k + 1)))
    near = 1.0 - near * a * F.exp(-square) * (2 / math.sqrt(math.pi))
    half = F.try_divide(F.lit(0.5), square)
    far = F.aggregate(down(_LEVELS), F.lit(1.0), lambda acc, k: 1.0 + half * k / acc)
    far = F.try_divide(F.exp(-square), a * far * math.sqrt(math.pi))
    upper = F.when(a < _SPLIT, near).otherwise(far)
    return F.when(x < 0, 2.0 - upper).otherwise(upper)


def normal_cdf(z: Column) -> Column:
    return erfc(z * (-math.sqrt(0.5))) / 2


def normal_two_sided(z: Column) -> Column:
    """Chance of a normal value at least as far from zero; null for null and NaN."""
    return F.when(~F.isnan(z), erfc(F.abs(z) * math.sqrt(0.5)))


def chi_square_tail(q: Column, k: Column) -> Column:
    """Chance of a chi-square value of k (whole) degrees of freedom above q >= 0: a finite sum of positive terms."""
    h = q / 2
    odd = k % 2 == 1
    first = F.when(odd, F.exp(-h) * F.sqrt(h) * (2 / math.sqrt(math.pi))).otherwise(F.exp(-h))
    start = F.struct(F.when(odd, erfc(F.sqrt(h))).otherwise(F.lit(0.0)).alias("sum"), first.alias("term"))
    shift = F.when(odd, 0.5).otherwise(0.0)
    steps = F.when(k >= 2, F.sequence(F.lit(1), F.floor(k / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, lambda acc, j: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * h / (j + shift)).alias("term")))
    return F.when(q.isNotNull() & k.isNotNull(), F.least(F.lit(1.0), total["sum"]))


def erfc_sql(x: str) -> str:
    """The same for x >= 0 as SQL: one less the sum of x^(2n+1) sqrt(pi) / (2 Gamma(n + 3/2)), good to 1e-15."""
    return f"(CASE WHEN ({x}) = 0 THEN 1.0 WHEN ({x}) < 8 THEN greatest(0, 1 - exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 300), lambda n: exp((2 * n + 1) * ln(greatest(({x}), 1e-300)) - lgamma(n + 1.5))))) WHEN ({x}) IS NOT NULL THEN 0.0 END)"
