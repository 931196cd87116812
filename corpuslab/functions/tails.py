"""Tails and quantiles of Student's t and chi-squared, in plain Python: small arguments, driver side."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if math.isinf(t):
        return 0.0
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """t with P(T <= t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > 2 * (1 - p):
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 2 * (1 - p) else (lo, mid)
    return (lo + hi) / 2


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / ((step * d + b) or tiny)
        c = (b + step / c) or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_table(most: int, level: float = 0.95) -> list[tuple[int, float]]:
    """(df, critical value) for df from 1 to `most`."""
    return [(df, t_quantile(0.5 + level / 2, df)) for df in range(1, most + 1)]
