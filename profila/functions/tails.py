"""Tail probabilities of the t and chi-square distributions (scalars, standard library only)."""

from __future__ import annotations

import math

_TINY = 1e-300
_STEPS = 10_000


def _lentz(first: float, terms) -> float:
    """Value of a continued fraction first + a1/(b1 + a2/(b2 + ...)) (modified Lentz)."""
    value = first or _TINY
    upper, lower = value, 0.0
    for a, b in terms:
        lower = 1.0 / ((b + a * lower) or _TINY)
        upper = (b + a / upper) or _TINY
        value *= upper * lower
        if abs(upper * lower - 1.0) < 1e-15:
            break
    return value


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_fraction(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x))

    def terms():
        for m in range(_STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return front / (a * _lentz(1.0, terms()))


def pearson_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a Pearson coefficient over n pairs."""
    if r is None or n < 2:
        return None
    if n == 2:
        return 1.0
    return beta_fraction((n - 2) / 2, 0.5, max(0.0, 1.0 - r * r))


def chi2_p(chi2: float | None, dof: int) -> float | None:
    """Upper tail of the chi-square distribution."""
    if chi2 is None or dof < 1:
        return None
    if chi2 <= 0:
        return 1.0
    s, x = dof / 2, chi2 / 2
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        for k in range(1, _STEPS):
            term *= x / (s + k)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - front * total
    return front / _lentz(
        x + 1 - s, ((-k * (k - s), x + 2 * k + 1 - s) for k in range(1, _STEPS)))
