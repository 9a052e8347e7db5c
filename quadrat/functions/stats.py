"""P-values of paired tests, as pandas functions over columns; a handful of differences each."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified method of Lentz."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_p(t: float, df: float) -> float:
    """Two-sided p of a t statistic."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1 - front * _betacf(b, a, 1 - x) / b


def wilcoxon_p(d: np.ndarray) -> float | None:
    """Two-sided p of the signed-rank test without zeros: all signs for up to 16 differences, else normal; null if all are zero."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return None
    size = np.abs(d)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    if n <= 16:
        signs = np.array(list(product((0, 1), repeat=n)))
        sums = signs @ ranks
        return float(min(1.0, 2 * (sums <= w + 1e-9).mean()))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
    return float(math.erfc(abs(w - mean) / math.sqrt(2 * var)))


def _t_ps(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_p(a, b - 1) if pd.notna(a) and b > 1 else None for a, b in zip(t, n)], dtype="float64")


def _signed_rank_ps(differences: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_p(np.asarray(d, float)) if d is not None else None for d in differences], dtype="float64")


def paired_t_p(t: Column, n: Column) -> Column:
    """Two-sided p of the paired t statistic of n differences."""
    return F.pandas_udf(_t_ps, "double")(t, n)


def signed_rank_p(differences: Column) -> Column:
    """Two-sided p of the signed-rank test of an array of differences."""
    return F.pandas_udf(_signed_rank_ps, "double")(differences)
