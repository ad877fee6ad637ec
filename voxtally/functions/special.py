"""Distribution tails.  Spark has none built in, so these are vectorised pandas UDFs; they
run on one row per structure, pair or latent variable, never on the fact tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral (modified Lentz evaluation)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    out, live = d.copy(), np.ones(x.shape, dtype=bool)
    for m in range(1, 100_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / guard(1.0 + step * d)
            c = guard(1.0 + step / c)
            out = np.where(live, out * d * c, out)
        # each number is done on its own; rounding keeps some off 1 by more than a few units for ever
        live &= np.abs(d * c - 1.0) >= 1e-14
        if not live.any():
            return out
    raise ArithmeticError("the continued fraction of the incomplete beta integral did not converge")


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    out = np.where(x >= 1.0, 1.0, np.where(x <= 0.0, 0.0, np.nan))
    inside = (x > 0.0) & (x < 1.0) & (a > 0) & (b > 0)
    if inside.any():
        xi, ai, bi = x[inside], a[inside], b[inside]
        swap = xi > (ai + 1.0) / (ai + bi + 2.0)
        p, q, z = np.where(swap, bi, ai), np.where(swap, ai, bi), np.where(swap, 1.0 - xi, xi)
        log_front = (
            (_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float)
            + p * np.log(z)
            + q * np.log1p(-z)
        )
        tail = np.exp(log_front) * _beta_fraction(z, p, q) / p
        out[inside] = np.where(swap, 1.0 - tail, tail)
    return np.clip(out, 0.0, 1.0)


def f_tail(f, df1, df2) -> np.ndarray:
    """P(F > f)."""
    f, df1, df2 = (np.asarray(v, dtype=float) for v in (f, df1, df2))
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def t_tail2(t, df) -> np.ndarray:
    """P(|T| > |t|)."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    p = pd.Series(f_tail(f, df1, df2), index=f.index)
    return p.where(f.notna() & df1.notna() & df2.notna())


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    p = pd.Series(t_tail2(t, df), index=t.index)
    return p.where(t.notna() & df.notna())


# Coefficients of a rational approximation of the normal quantile (relative error below 1.2e-9).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
QUANTILE_TAIL = 0.02425


def horner(coefficients, x):
    """The polynomial with these coefficients, highest power first."""
    total = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        total = total * x + F.lit(float(c))
    return total


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal as an expression; 0 and 1 give -inf and inf, others outside NULL."""
    q, tail = p - F.lit(0.5), F.least(p, F.lit(1.0) - p)
    r = q * q
    s = F.sqrt(F.lit(-2.0) * F.ln(tail))
    outer = horner(QUANTILE_C, s) / horner(QUANTILE_D, s)
    inner = horner(QUANTILE_A, r) * q / horner(QUANTILE_B, r)
    return (
        F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).when((p < 0) | (p > 1) | F.isnan(p), F.lit(None).cast("double"))
        .when(p < QUANTILE_TAIL, outer).when(p > 1 - QUANTILE_TAIL, -outer).otherwise(inner)
    )


# Coefficients of a rational approximation of erfc(|z|) * exp(z^2), by Chebyshev fitting (relative error below 1.2e-7).
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def normal_cdf(x: Column) -> Column:
    """P(Z <= x) of the standard normal as an expression, of relative error below 1.2e-7 in the lower tail."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + z / F.lit(2.0))
    tail = t * F.exp(horner(ERFC, t) - z * z) / F.lit(2.0)
    return F.when(F.isnan(x), F.lit(None).cast("double")).when(x < 0, tail).otherwise(F.lit(1.0) - tail)


HARMONIC_SUMMED = 32  # terms that are added one by one


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m of a whole m of at least 1, as an expression whose work does not grow with m.

    Beyond a few terms by Euler's and Maclaurin's formula, whose error is below rounding there."""
    n = F.lit(HARMONIC_SUMMED)
    summed = F.aggregate(F.sequence(F.lit(1), F.least(m, n).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    x = m.cast("double")
    r = F.lit(1.0) / (x * x)
    series = horner((-1 / 252, 1 / 120, -1 / 12, 0.0), r)
    return F.when(m <= n, summed).otherwise(F.ln(x) + F.lit(0.5772156649015329) + F.lit(0.5) / x + series)
