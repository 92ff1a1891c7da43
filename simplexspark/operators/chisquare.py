"""Chi-square distribution: the incomplete gamma function and quantiles."""

from __future__ import annotations

import math


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series below a+1 and by its
    continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * front
    # Evaluated from the tail inwards.
    frac = 0.0
    for i in range(500, 0, -1):
        frac = i * (i - a) / (x + 2 * i + 1 - a - frac)
    return 1.0 - front / (x + 1 - a - frac)


def chi2_quantile(p: float, df: int) -> float:
    """Chi-square quantile by bisection."""
    lo, hi = 0.0, 10.0 + 10.0 * df
    while gamma_p(df / 2, hi / 2) < p and hi < 1e6:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2
