"""Closed forms of confidence intervals and special functions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963985


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Wilson 95 % interval of a share; (0, 0) where n is 0."""
    p, z2 = F.try_divide(hits, n), Z95 * Z95
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), F.lit(Z95) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    empty = n == 0
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), middle + half))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, df: float) -> float:
    """Bisection on the distribution function, from a Wilson-Hilferty guess."""
    z = NormalDist().inv_cdf(p)
    guess = max(1e-8, df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3)
    low, high = 0.0, 2 * guess + 50
    for _ in range(200):
        mid = (low + high) / 2
        if gamma_p(df / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def poisson_interval(n: int) -> tuple[float, float]:
    """Exact 95 % interval of a Poisson mean from a count."""
    return (0.0 if n == 0 else chi2_quantile(0.025, 2 * n) / 2, chi2_quantile(0.975, 2 * n + 2) / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    """Probability of a Student t beyond +-t."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def t_quantile(df: float, two_sided: float = 0.05) -> float:
    """The t beyond which, on both sides, lies that share; infinite for df < 1."""
    if df < 1:
        return math.inf
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > two_sided:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > two_sided else (low, mid)
    return (low + high) / 2


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs; nan below three."""
    if n < 3 or not -1 <= r <= 1:
        return math.nan
    return 0.0 if abs(r) == 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def strength(r: Column) -> Column:
    """The size of a correlation in words."""
    a = F.abs(r)
    return F.when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate").when(a < 0.7, "strong").when(a.isNotNull(), "very strong")
