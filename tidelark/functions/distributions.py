"""Tails of the t, F, chi-squared and normal distributions, for tests on small tables of statistics."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    """P(X > x), by the series of the lower incomplete gamma function or the upper one's fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        tail = t_tail(mid, df) / 2
        low, high = (mid, high) if (1 - tail if mid > 0 else tail) < p else (low, mid)
    return (low + high) / 2
