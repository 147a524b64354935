"""Distribution functions for tests, in plain Python: they run on a handful of numbers on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def gammainc(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > 1e-17 * abs(total):
        n += 1
        term *= x / n
        total += term
        if n > a + 10_000:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        cdf = 1 - t_two_sided(mid, df) / 2 if mid > 0 else t_two_sided(mid, df) / 2
        low, high = (mid, high) if cdf < p else (low, mid)
    return (low + high) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return 1 - gammainc(df / 2, x / 2)


def wilcoxon_two_sided(w: float, n: int, exact: bool = True) -> float:
    """For the smaller rank sum w of n nonzero differences: exact by counting sign patterns, else by the normal limit."""
    if n == 0:
        return 1.0
    if exact and n <= 50:
        counts = [1]
        for r in range(1, n + 1):
            counts = [(counts[i] if i < len(counts) else 0) + (counts[i - r] if 0 <= i - r < len(counts) else 0) for i in range(len(counts) + r)]
        return min(1.0, 2 * sum(counts[: int(math.floor(w)) + 1]) / 2**n)
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return min(1.0, 2 * NormalDist().cdf((w - mean) / sd))
