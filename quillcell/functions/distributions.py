"""Distribution functions Spark SQL lacks, as Arrow-batched pandas UDFs.

Student-t and chi-square tails come from the regularised incomplete beta and gamma
functions, evaluated with the continued fractions and series of Press et al.,
Numerical Recipes (chapter 6), on whole batches at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _erfc(x):
    return np.asarray(np.frompyfunc(math.erfc, 1, 1)(np.asarray(x, float)), float)


def _lgamma(x):
    """Taken once for each distinct value: degrees of freedom repeat."""
    x = np.asarray(x, float)
    distinct, back = np.unique(x, return_inverse=True)
    return np.asarray(np.frompyfunc(math.lgamma, 1, 1)(distinct), float)[back].reshape(x.shape)


def normal_sf_np(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def betainc_np(a, b, x, iterations: int = 400):
    """Regularised incomplete beta I_x(a, b), elementwise."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    inside = (xx > 0) & (xx < 1)
    safe = np.where(inside, xx, 0.5)
    front = np.exp(
        _lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(safe) + bb * np.log1p(-safe)
    ) / aa
    c = np.ones_like(safe)
    d = 1.0 - (aa + bb) * safe / (aa + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, iterations + 1):
        for num in (
            m * (bb - m) * safe / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * safe / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if h.size == 0 or np.nanmax(np.abs(step - 1.0)) < 1e-15:
            break
    part = np.where(inside, front * h, np.where(xx >= 1, 1.0, 0.0))
    return np.where(flip, 1.0 - part, part)


def student_t_sf_np(t, df):
    """P(T > t) with ``df`` degrees of freedom."""
    t, df = (np.array(v, float) for v in np.broadcast_arrays(t, df))
    both = betainc_np(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(np.isnan(t), np.nan, np.where(t >= 0, both / 2.0, 1.0 - both / 2.0))


def gammainc_upper_np(a, x, iterations: int = 2000):
    """Regularised upper incomplete gamma Q(a, x), elementwise."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    bad = np.isnan(a) | np.isnan(x)
    xs = np.where(bad | (x <= 0), 1.0, x)
    aa = np.where(bad, 1.0, a)
    scale = np.exp(-xs + aa * np.log(xs) - _lgamma(aa))
    low = xs < aa + 1.0
    # series for the lower part
    term = 1.0 / aa
    total, n = term.copy(), aa.copy()
    for _ in range(iterations):
        n = n + 1.0
        term = np.where(low, term * xs / n, 0.0)
        total = total + term
        if not np.any(term > total * 1e-16):
            break
    # continued fraction for the upper part
    b = xs + 1.0 - aa
    c = np.full_like(xs, 1.0 / _TINY)
    d = 1.0 / np.where(np.abs(b) < _TINY, _TINY, b)
    h = d.copy()
    for i in range(1, iterations + 1):
        an = -i * (i - aa)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = d * c
        h = np.where(low, h, h * step)
        if np.all(low | (np.abs(step - 1.0) < 1e-15)):
            break
    q = np.where(low, 1.0 - scale * total, scale * h)
    q = np.where(x <= 0, 1.0, np.clip(q, 0.0, 1.0))
    return np.where(bad, np.nan, q)


def hypergeom_upper_np(hits, drawn, marked, population):
    """P(X >= hits) when ``drawn`` of ``population`` items are taken and ``marked`` are special.

    The sum runs over the possible hits of one batch row at a time, all rows together.
    """
    hits, drawn, marked, population = (np.asarray(v, float) for v in (hits, drawn, marked, population))
    top = np.minimum(drawn, marked)
    base = (
        _lgamma(marked + 1) + _lgamma(population - marked + 1)
        + _lgamma(drawn + 1) + _lgamma(population - drawn + 1) - _lgamma(population + 1)
    )
    total = np.zeros(len(hits))
    k = np.maximum(hits, drawn + marked - population)
    k = np.maximum(k, 0.0)
    while len(k) and np.any(k <= top):
        live = k <= top
        kk = np.where(live, k, top)
        log_p = base - (
            _lgamma(kk + 1) + _lgamma(marked - kk + 1) + _lgamma(drawn - kk + 1)
            + _lgamma(population - marked - drawn + kk + 1)
        )
        total += np.where(live, np.exp(log_p), 0.0)
        k = k + 1
    return np.minimum(total, 1.0)


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf_np(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def student_t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_t_sf_np(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gammainc_upper_np(df.to_numpy(float) / 2.0, x.to_numpy(float) / 2.0))


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided Fisher exact p-value of the table ``[[a, b], [c, d]]``."""
    a, b, c, d = (s.to_numpy(float) for s in (a, b, c, d))
    return pd.Series(hypergeom_upper_np(a, a + b, a + c, a + b + c + d))
