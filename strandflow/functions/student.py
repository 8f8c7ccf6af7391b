"""Two-sided Student t factor as an Arrow UDF.

Spark has no inverse t distribution. The factor is only needed once per output
row of a summary (patient x metric), never per curve.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _upper_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for t > 0: half the regularised incomplete beta at df/(df+t^2)."""
    a, b = df / 2.0, np.full_like(df, 0.5)
    x = df / (df + t * t)
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    lg = np.vectorize(lgamma)
    with np.errstate(divide="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
    # Continued fraction of the incomplete beta, modified Lentz evaluation.
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1.0 - (p + q) * z / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    frac = d.copy()
    for m in range(1, 400):
        for num in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            frac = frac * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    inc = np.where(flip, 1.0 - front * frac, front * frac)
    return 0.5 * inc


def t_quantile(df: np.ndarray, upper: float) -> np.ndarray:
    """t such that P(T > t) = ``upper`` for each df (df >= 1), by Newton steps from 0.

    The tail falls and is convex there, so no step passes the root.
    """
    df = np.asarray(df, dtype=float)
    lg = np.vectorize(lgamma)
    scale = np.exp(lg((df + 1) / 2) - lg(df / 2)) / np.sqrt(df * np.pi)
    t = (0.5 - upper) / scale
    for _ in range(100):
        step = (_upper_tail(t, df) - upper) / (scale * np.exp(-(df + 1) / 2 * np.log1p(t * t / df)))
        t = t + step
        if np.all(np.abs(step) <= 1e-15 * t):
            break
    return t


def t_factor(df: Column, alpha: float = 0.05) -> Column:
    """NULL for df < 1."""

    def factor(values: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=values.index)
        ok = values.notna() & (values >= 1)
        if ok.any():
            uniq, inverse = np.unique(values[ok].to_numpy(dtype=float), return_inverse=True)
            out[ok] = t_quantile(uniq, alpha / 2.0)[inverse]
        return out

    return F.pandas_udf(factor, "double")(df.cast("double"))
