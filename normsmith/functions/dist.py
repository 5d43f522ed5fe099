"""F, t and normal quantiles without SciPy.

Regularised incomplete beta by its continued fraction (modified Lentz), the
F and t distribution functions from it, and quantiles by bisection.  These
run on one row per task/test (a handful of values), inside a pandas UDF.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def _betacf(a: float, b: float, x: float, eps: float = 1e-15, itmax: int = 10000) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, itmax + 1):
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
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def f_cdf(x: float, d1: float, d2: float) -> float:
    if x <= 0:
        return 0.0
    return betainc(d1 / 2.0, d2 / 2.0, d1 * x / (d1 * x + d2))


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x)
    return 1.0 - tail if t >= 0 else tail


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) from the tail itself (1 - cdf would cancel to 0)."""
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def _bisect(cdf, p: float, lo: float, hi: float, iters: int = 200) -> float:
    while cdf(hi) < p:
        lo, hi = hi, hi * 2.0
        if hi > 1e300:
            return math.inf
    for _ in range(iters):
        mid = 0.5 * (lo + hi)
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def f_ppf(p: float, d1: float, d2: float) -> float:
    """Quantile of the F(d1, d2) distribution; NaN for bad parameters."""
    if not (0.0 < p < 1.0) or not (d1 > 0 and d2 > 0) or math.isnan(d1) or math.isnan(d2):
        return math.nan
    return _bisect(lambda x: f_cdf(x, d1, d2), p, 0.0, 1.0)


def t_ppf(p: float, df: float) -> float:
    if not (0.0 < p < 1.0) or not df > 0:
        return math.nan
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    return _bisect(lambda x: t_cdf(x, df), p, 0.0, 1.0)


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def icc2k_bounds(msb: float, msj: float, mse: float, n: int, k: int, conf: float = 0.95) -> tuple[float, float]:
    """Confidence bounds of ICC(2,k) (Shrout & Fleiss 1979; McGraw & Wong
    1996): Satterthwaite df for the rater term, F quantiles, then the
    Spearman-Brown step to k raters."""
    if n is None or k is None or n < 2 or k < 2 or mse is None or mse <= 0:
        return (math.nan, math.nan)
    q = 1.0 - (1.0 - conf) / 2.0
    r = (msb - mse) / (msb + (k - 1) * mse + k * (msj - mse) / n)
    fj = msj / mse
    a = n * (1 + (k - 1) * r) - k * r
    v = (k - 1) * (n - 1) * (k * r * fj + a) ** 2 / ((n - 1) * k * k * r * r * fj * fj + a * a)
    f1 = f_ppf(q, n - 1, v)
    f2 = f_ppf(q, v, n - 1)
    c = k * msj + (k * n - k - n) * mse
    lo = n * (msb - f1 * mse) / (f1 * c + n * msb)
    hi = n * (f2 * msb - mse) / (c + n * f2 * msb)

    def up(x: float) -> float:
        return k * x / (1 + (k - 1) * x)

    return (up(lo), up(hi))


# ------------------------------------------------------------ whole columns
def _lgamma(x: np.ndarray) -> np.ndarray:
    # no np.vectorize: it keeps a ufunc that can not travel to the workers
    x = np.asarray(x, dtype=float)
    return np.array([math.lgamma(v) for v in x.ravel()], dtype=float).reshape(x.shape)


def _betacf_array(a: np.ndarray, b: np.ndarray, x: np.ndarray, eps: float = 1e-15, itmax: int = 10000) -> np.ndarray:
    tiny = 1e-300

    def safe(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) > tiny, v, tiny)

    c = np.ones_like(x)
    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, itmax + 1):
        for aa in (m * (b - m) * x / ((a - 1.0 + 2 * m) * (a + 2 * m)),
                   -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1.0 + 2 * m))):
            d = 1.0 / safe(1.0 + aa * d)
            c = safe(1.0 + aa / c)
            h *= d * c
        if (np.abs(d * c - 1.0) < eps).all():
            break
    return h


def betainc_array(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``betainc`` of whole columns."""
    inside = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    left = inside < (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(left, a, b), np.where(left, b, a), np.where(left, inside, 1.0 - inside)
    part = front * _betacf_array(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(left, part, 1.0 - part)))


def f_ppf_array(p: float, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Quantiles of F(d1, d2) by bisection of all rows at once; NaN for bad
    parameters."""
    ok = (d1 > 0) & (d2 > 0) & np.isfinite(d1) & np.isfinite(d2)
    a, b = np.where(ok, d1, 1.0) / 2.0, np.where(ok, d2, 1.0) / 2.0

    def cdf(v: np.ndarray) -> np.ndarray:
        return betainc_array(a, b, a * v / (a * v + b))

    lo, hi = np.zeros_like(a), np.ones_like(a)
    while (short := (cdf(hi) < p) & (hi < 1e300)).any():
        lo, hi = np.where(short, hi, lo), np.where(short, hi * 2.0, hi)
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        if (hi - lo <= 1e-15 * np.maximum(1.0, np.abs(mid))).all():
            break
    return np.where(ok, 0.5 * (lo + hi), np.nan)


def icc2k_bounds_array(msb, msj, mse, n, k, conf: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """``icc2k_bounds`` of whole columns."""
    msb, msj, mse, n, k = (np.asarray(v, dtype=float) for v in (msb, msj, mse, n, k))
    ok = (n >= 2) & (k >= 2) & (mse > 0) & np.isfinite(msb) & np.isfinite(msj)
    with np.errstate(all="ignore"):
        q = 1.0 - (1.0 - conf) / 2.0
        r = (msb - mse) / (msb + (k - 1) * mse + k * (msj - mse) / n)
        fj = msj / mse
        a = n * (1 + (k - 1) * r) - k * r
        v = (k - 1) * (n - 1) * (k * r * fj + a) ** 2 / ((n - 1) * k * k * r * r * fj * fj + a * a)
        v, df = np.where(ok, v, np.nan), np.where(ok, n - 1, np.nan)
        f1, f2 = f_ppf_array(q, df, v), f_ppf_array(q, v, df)
        c = k * msj + (k * n - k - n) * mse
        bounds = (n * (msb - f1 * mse) / (f1 * c + n * msb), n * (f2 * msb - mse) / (c + n * f2 * msb))
        return tuple(np.where(ok, k * x / (1 + (k - 1) * x), np.nan) for x in bounds)
