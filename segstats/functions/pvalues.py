"""Vectorised (Arrow-batched) p-value helpers for small result tables.

Kept without postponed annotations: pandas UDF type hints must be real types.
"""

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def student_t_two_sided(t, df):
    """Two-sided p of Student's t with ``df`` degrees of freedom:
    the regularised incomplete beta I_{df/(df+t^2)}(df/2, 1/2)."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    x = df / (df + t * t)
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    a, b = df / 2.0, 0.5
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def regularized_beta(a, b, x):
    """I_x(a, b), the regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def f_test_p(f, d1, d2):
    """Upper tail of the F distribution: P(F' >= f) = I_{d2/(d2+d1 f)}(d2/2, d1/2)."""
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return None
    if f <= 0:
        return 1.0
    return regularized_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x, df):
    """Upper tail of the chi-square distribution: Q(df/2, x/2), from the
    series (x < a + 1) or the continued fraction of the incomplete gamma."""
    if x is None or df is None or df <= 0 or math.isnan(x):
        return None
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    gln = math.lgamma(a)
    if z < a + 1.0:
        term = total = 1.0 / a
        ap = a
        for _ in range(1000):
            ap += 1.0
            term *= z / ap
            total += term
            if abs(term) < abs(total) * 3e-16:
                break
        return 1.0 - total * math.exp(-z + a * math.log(z) - gln)
    tiny = 1e-300
    b = z + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return math.exp(-z + a * math.log(z) - gln) * h


@F.pandas_udf(T.DoubleType())
def anova_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """p of a one-way ANOVA F with (d1, d2) degrees of freedom."""
    return pd.Series([f_test_p(float(a), float(b), float(c)) if pd.notna(a) and pd.notna(b) and pd.notna(c) else None
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper-tail chi-square p (Kruskal-Wallis H with k - 1 degrees of freedom)."""
    return pd.Series([chi2_sf(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, n: pd.Series) -> pd.Series:
    """p of Pearson's r from t and the number of pairs n (df = n - 2)."""
    out = [student_t_two_sided(float(a), float(b) - 2.0) if pd.notna(a) and pd.notna(b) else None
           for a, b in zip(t, n)]
    return pd.Series(out, dtype="float64")
