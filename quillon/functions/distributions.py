"""Distribution functions: Column expressions where a closed form exists, numpy kernels otherwise.

The normal distribution is an expression inside the JVM (published rational
approximations; absolute error about 1e-15, relative 1e-8 far out). Incomplete gamma and beta functions, by
their published continued fractions and series, run on whole Arrow batches;
p-values are needed per group, not per row, so they see aggregated rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()
#: Published coefficients of the normal tail below 7.07, highest power first.
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_FAR, TAIL_END = 7.07106781186547, 37.0
ROOT_TAU = 2.506628274631


def z_value(alpha: float) -> float:
    """Two-sided critical value of the standard normal."""
    return NORMAL.inv_cdf(1 - alpha / 2)


def normal_cdf(x) -> np.ndarray:
    x = np.asarray(x, float)
    z = np.abs(x)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        near = np.polyval(TAIL_TOP, z) / np.polyval(TAIL_BOTTOM, z)
        far = 1 / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / ROOT_TAU
        tail = np.where(z > TAIL_END, 0.0, np.exp(-z * z / 2) * np.where(z < TAIL_FAR, near, far))
    return np.where(x > 0, 1 - tail, tail)


def lgamma(x) -> np.ndarray:
    """ln of the gamma function of positive numbers: Stirling's series, from 12 on."""
    x = np.asarray(x, float)
    low = x < 12
    y = np.where(low, x + 12, x)
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    rise = sum(np.log(np.where(low, x + k, 1.0)) for k in range(12))
    return series - rise


def _fraction(start, terms: Callable[[int], list], most: int, shape) -> np.ndarray:
    """Lentz's value of continued fractions, all at a time; ``terms(m)`` gives pairs (a, b) of a / (b + ...)."""
    tiny = 1e-300
    out = np.where(np.abs(start) < tiny, tiny, start) * np.ones(shape)
    c, d = out.copy(), np.zeros(shape)
    for m in range(1, most):
        for a, b in terms(m):
            d = b + a * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + a / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
        if np.nanmax(np.abs(c * d - 1), initial=0.0) < 1e-15:
            break
    return out


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta functions by their continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    good = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    a, b, x = a[good], b[good], x[good]
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a

    def terms(m):
        return [(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0), (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0)]

    # 1 / (1 + d1 / (1 + d2 / ...)): the first term does not fit the pairs.
    first = 1 - (a + b) * x / (a + 1)
    value = front / _beta_fraction(first, terms, x.shape)
    out[good] = np.where(swap, 1 - value, value)
    return out


def _beta_fraction(first, terms, shape) -> np.ndarray:
    """1 + d1 / (1 + d2 / (1 + ...)) with 1 + d1 given as ``first``."""
    tiny = 1e-300
    d = 1 / np.where(np.abs(first) < tiny, tiny, first)
    c, out = np.ones(shape), d.copy()
    for m in range(1, 2000):
        for a, _ in terms(m):
            d = 1 + a * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + a / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
        if np.max(np.abs(c * d - 1), initial=0.0) < 1e-15:
            break
    return 1 / out


def beta_ppf(p, a, b) -> np.ndarray:
    """Quantiles of beta distributions by bisection."""
    p, a, b = (np.array(v, float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(60):
        mid = (low + high) / 2
        below = beta_inc(a, b, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(np.isnan(p) | np.isnan(a) | np.isnan(b), np.nan, (low + high) / 2)


def gamma_sf(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma functions: a series below a + 1, a continued fraction above."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    out = np.where(x <= 0, 1.0, np.nan)
    for series in (True, False):
        part = (x > 0) & (a > 0) & ((x < a + 1) if series else (x >= a + 1))
        k, v = a[part], x[part]
        front = np.exp(k * np.log(v) - v - lgamma(k))
        if series:
            term = total = 1 / k
            for i in range(1, 100_000):
                term = term * v / (k + i)
                total = total + term
                if np.all(term <= total * 1e-17):
                    break
            out[part] = 1 - total * front
        else:
            fraction = _fraction(v + 1 - k, lambda i, k=k, v=v: [(-i * (i - k), v + 1 - k + 2 * i)], 100_000, v.shape)
            out[part] = front / fraction
    return out


def t_sf(t, df) -> np.ndarray:
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def _kernel(f, *columns) -> Column:
    """A numpy function of batches of columns; null where one of them is."""

    @F.pandas_udf("double")
    def run(table: pd.DataFrame) -> pd.Series:
        values = table.to_numpy(float)
        out = np.full(len(values), np.nan)
        known = ~np.isnan(values).any(axis=1)
        if known.any():
            out[known] = f(*values[known].T)
        return pd.Series(out)

    return F.nanvl(run(F.struct(*(_d(c).alias(f"c{k}") for k, c in enumerate(columns)))), F.lit(None).cast("double"))


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def chi2_sf_col(x, df) -> Column:
    """P(chi-squared with df degrees > x)."""
    return _kernel(lambda a, k: gamma_sf(k / 2, a / 2), x, df)


def t_p_col(t, df) -> Column:
    """Two-sided p of Student's t."""
    return _kernel(t_sf, t, df)


def normal_cdf_col(z) -> Column:
    """P(normal < z), inside the JVM; null where z is null or not a number."""
    x = F.nanvl(_d(z), F.lit(None).cast("double"))
    a = F.abs(x)
    poly = lambda c: _horner([F.lit(v) for v in c], a)
    far = 1 / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / ROOT_TAU
    tail = F.when(a > TAIL_END, F.lit(0.0)).otherwise(F.exp(-a * a / 2) * F.when(a < TAIL_FAR, poly(TAIL_TOP) / poly(TAIL_BOTTOM)).otherwise(far))
    return F.when(x > 0, 1 - tail).when(x <= 0, tail)


def normal_cdf_sql(z: str) -> str:
    """DuckDB expression of the same."""
    poly = lambda c: _horner([repr(v) for v in c], "a", lambda s, x, v: f"({s} * {x} + {v})")
    tail = f"CASE WHEN a > {TAIL_END} THEN 0 ELSE exp(-a * a / 2) * CASE WHEN a < {TAIL_FAR} THEN {poly(TAIL_TOP)} / {poly(TAIL_BOTTOM)} ELSE 1 / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / {ROOT_TAU} END END"
    return f"list_transform([abs(({z})::DOUBLE)], lambda a: CASE WHEN ({z}) > 0 THEN 1 - ({tail}) WHEN ({z}) <= 0 THEN {tail} END)[1]"


def _horner(coefficients: list, x, step=lambda s, x, v: s * x + v):
    out = coefficients[0]
    for v in coefficients[1:]:
        out = step(out, x, v)
    return out


def beta_ppf_col(p, a, b) -> Column:
    return _kernel(beta_ppf, p, a, b)


def log_factorial_col(n) -> Column:
    """ln(n!) by exact sums below 20 and Stirling's series (error below 1e-12) from there on: no lookup table, any n."""
    x = _d(n) + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    small = F.get(F.array(*(F.lit(math.lgamma(k + 1)) for k in range(20))), _d(n).cast("int"))
    return F.when(_d(n) < 20, small).otherwise(series)


def log_choose_col(n, k) -> Column:
    return log_factorial_col(n) - log_factorial_col(k) - log_factorial_col(_d(n) - _d(k))
