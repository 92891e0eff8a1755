"""Upper tails of the F, chi-squared and normal distributions, accurate far out (p of 1e-300)."""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def _lentz(terms, start: float, limit: int = 20_000) -> float:
    """Continued fraction start + a1/(b1 + a2/(b2 + ...)) by the modified Lentz scheme."""
    value = start or _TINY
    c, d = value, 0.0
    for k in range(1, limit):
        a, b = terms(k)
        d = b + a * d or _TINY
        c = b + a / c or _TINY
        d = 1.0 / d
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-16:
            break
    return value


def _log_beta_part(x: float, a: float, b: float) -> float:
    """log I_x(a, b) where the fraction converges fast: x < (a + 1) / (a + b + 2)."""

    def terms(k: int) -> tuple[float, float]:
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    return front - math.log(_lentz(terms, 1.0))


def f_sf(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if math.isnan(f):
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    x = df2 / (df2 + df1 * f)
    a, b = df2 / 2, df1 / 2
    if x < (a + 1) / (a + b + 2):
        return math.exp(_log_beta_part(x, a, b))
    rest = df1 * f / (df2 + df1 * f)
    return -math.expm1(_log_beta_part(rest, b, a)) if rest > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    """P(chi-squared > x)."""
    if math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, h = df / 2, x / 2
    front = a * math.log(h) - h - math.lgamma(a)
    if h < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1.0 - math.exp(front) * total)
    fraction = _lentz(lambda k: (-k * (k - a), h + 1 - a + 2 * k), h + 1 - a)
    return math.exp(front) / fraction


def normal_isf(p: float) -> float:
    """z with P(Z > z) = p."""
    if math.isnan(p):
        return math.nan
    if p <= 0:
        return math.inf
    if p >= 1:
        return -math.inf
    return -NormalDist().inv_cdf(p)
