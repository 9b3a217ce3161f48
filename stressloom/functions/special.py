"""Tail probabilities as Arrow-batched functions, applied to result rows only.

Incomplete gamma and beta functions by series and continued fractions, vectorised over the batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def gamma_q(a, x):
    """Upper regularised incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    pos = x > 0
    low = pos & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1.0 / aa
        total = term.copy()
        for k in range(1, 2000):
            term = term * xx / (aa + k)
            total += term
            if np.all(np.abs(term) < 1e-16 * np.abs(total)):
                break
        out[low] = 1.0 - total * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    high = pos & ~low
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1.0 - aa
        c = np.full(aa.shape, 1e300)
        d = 1.0 / b
        h = d.copy()
        for k in range(1, 2000):
            an = -k * (k - aa)
            b = b + 2.0
            d = 1.0 / _floor(an * d + b)
            c = _floor(b + an / c)
            step = d * c
            h *= step
            if np.all(np.abs(step - 1.0) < 1e-15):
                break
        out[high] = np.exp(-xx + aa * np.log(xx) - _lgamma(aa)) * h
    return out


def _floor(v):
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def beta_i(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    xs = np.clip(xx, 1e-300, 1.0 - 1e-16)
    front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xs) + bb * np.log1p(-xs)) / aa
    c = np.ones(aa.shape)
    d = 1.0 / _floor(1.0 - (aa + bb) * xs / (aa + 1.0))
    h = d.copy()
    for m in range(1, 500):
        for num in (
            m * (bb - m) * xs / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * xs / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1.0 / _floor(1.0 + num * d)
            c = _floor(1.0 + num / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    val = np.where(xx <= 0, 0.0, front * h)
    return np.where(flip, 1.0 - val, val)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_i(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * np.maximum(f, 0.0)))


def chi2_sf(x, df):
    return gamma_q(np.asarray(df, float) / 2.0, np.maximum(np.asarray(x, float), 0.0) / 2.0)


def _masked(f, *series: pd.Series) -> pd.Series:
    vals = [s.to_numpy(dtype=float) for s in series]
    ok = np.all([np.isfinite(v) for v in vals], axis=0)
    out = np.full(len(series[0]), np.nan)
    if ok.any():
        out[ok] = f(*[v[ok] for v in vals])
    return pd.Series(out).where(ok, None)


@F.pandas_udf(T.DoubleType())
def _norm_p(z: pd.Series) -> pd.Series:
    return _masked(lambda v: 2.0 * norm_sf(np.abs(v)), z)


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _masked(f_sf, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(chi2_sf, x, df)


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def p_normal(z) -> Column:
    """Two-sided normal p."""
    return _norm_p(_d(z))


def p_student(t, df) -> Column:
    """Two-sided Student p."""
    return _t_p(_d(t), _d(df))


def p_fisher(f, d1, d2) -> Column:
    return _f_p(_d(f), _d(d1), _d(d2))


def p_chi2(x, df) -> Column:
    return _chi2_p(_d(x), _d(df))
