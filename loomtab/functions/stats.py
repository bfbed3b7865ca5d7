"""Tail probabilities and small-matrix helpers, for statistics tables of a few rows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * lead)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return lead * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def kolmogorov_sf(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sided p-value of the two-sample KS statistic."""
    en = n1 * n2 / (n1 + n2)
    if d <= 0:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2 * j * j * en * d * d) for j in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def kolmogorov_exact_sf(d: float, n1: int, n2: int) -> float:
    """Exact two-sided p-value of the two-sample KS statistic, by counting lattice paths.

    Of all orders in which n1 and n2 values can be merged, the share whose path somewhere lies as far from
    the diagonal as ``d`` says.  Diagonal by diagonal, entry i has the share of paths to (i, s - i) that did.
    """
    far = round(d * n1 * n2)
    if far <= 0:
        return 1.0
    i = np.arange(n1 + 1)
    hit = np.zeros(n1 + 1)
    for s in range(1, n1 + n2 + 1):
        before = np.concatenate([[0.0], hit[:-1]])
        j = s - i
        hit = (before * i + hit * np.maximum(j, 0)) / s
        hit[np.abs(i * n2 - j * n1) >= far] = 1.0
        hit[(j < 0) | (j > n2)] = 0.0
    return float(min(1.0, hit[n1]))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _cdf_grid(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v) for v in (-z / math.sqrt(2)).tolist()])


def studentized_range_sf(q: float, k: int) -> float:
    """Survival of the studentised range with infinite degrees of freedom, by quadrature."""
    z = np.linspace(-9, 9 + max(q, 0), 4001)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = _cdf_grid(z)
    lower = _cdf_grid(z - q)
    inside = k * phi * (upper - lower) ** (k - 1)
    return min(1.0, max(0.0, 1 - float(np.sum((inside[1:] + inside[:-1]) / 2 * np.diff(z)))))


def studentized_range_quantile(alpha: float, k: int) -> float:
    low, high = 0.0, 20.0
    for _ in range(45):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_sf(mid, k) > alpha else (low, mid)
    return (low + high) / 2


def _applied(f, *columns: Column) -> Column:
    """A scalar function over the few rows of a statistics table, Arrow-batched; null in, null out.

    Made when a query is built, as that needs a session.
    """

    @pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*series)], dtype="float64")

    return run(*columns)


def _chi2_or_one(x: float, df: float) -> float:
    return 1.0 if df <= 0 else chi2_sf(x, df)


def _nemenyi(q: float, k: float) -> float:
    return studentized_range_sf(q * math.sqrt(2), int(k))


def chi2_p(x, df) -> Column:
    return _applied(_chi2_or_one, *map(_col, (x, df)))


def ks_p(d, n1, n2, exact_up_to: int = 0) -> Column:
    """p-value of the two-sample KS statistic: exact where both sides have at most ``exact_up_to`` values, else asymptotic."""

    def p(d: float, n1: float, n2: float) -> float:
        return kolmogorov_exact_sf(d, int(n1), int(n2)) if max(n1, n2) <= exact_up_to else kolmogorov_sf(d, n1, n2)

    return _applied(p, *map(_col, (d, n1, n2)))


def digamma(x: Column) -> Column:
    """Of numbers above 0, by its series beyond 6 and the recurrence below, to about 1e-12."""
    y = x + 6
    r = 1 / (y * y)
    series = F.ln(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return series - sum((1 / (x + i) for i in range(1, 6)), 1 / x)


def nemenyi_p(q, k) -> Column:
    return _applied(_nemenyi, *map(_col, (q, k)))


def nemenyi_q(k, alpha) -> Column:
    """Critical value of the rank gap, in units of its standard error."""
    return _applied(_critical, *map(_col, (k, alpha)))


@lru_cache(maxsize=256)
def _critical(k: float, alpha: float) -> float:
    return studentized_range_quantile(alpha, int(k)) / math.sqrt(2)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate on the rows where both are set; null for constants."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    under = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(under > 0, under)


# Coefficients of a rational approximation of the inverse normal distribution.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution of a column in (0, 1), to about 1e-9."""
    q = p - 0.5
    r = q * q
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = _poly(_C, tail) / (_poly(_D, tail) * tail + 1)
    centre = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    return F.when(p < 0.02425, outer).when(p > 1 - 0.02425, -outer).otherwise(centre)


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution of numbers in (0, 1), to about 1e-9; NaN stays."""
    q = p - 0.5
    r = q * q
    out = np.polyval(_A, r) * q / (np.polyval(_B, r) * r + 1)
    far = (p < 0.02425) | (p > 1 - 0.02425)
    tail = np.sqrt(-2 * np.log(np.minimum(p[far], 1 - p[far])))
    outer = np.polyval(_C, tail) / (np.polyval(_D, tail) * tail + 1)
    out[far] = np.where(q[far] < 0, outer, -outer)
    return out


def normal_distributions(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, by a series-free rational approximation to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return np.where(x >= 0, 1 - upper, upper)
