"""Student's t and the F distribution for a few numbers: results of aggregates, one row a group."""

from __future__ import annotations

from math import exp, isfinite, lgamma, log, log1p


def _continued(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued(a, b, x) / a
    return 1 - front * _continued(b, a, 1 - x) / b


def t_two_sided(t: float | None, dof: float | None) -> float | None:
    """p value of Student's t, two-sided; None if t or its degrees of freedom are missing."""
    if t is None or dof is None or not dof > 0:
        return None
    return beta_share(dof / 2, 0.5, dof / (dof + t * t))


def f_quantile(share: float, dof: float, other: float) -> float | None:
    """The value below which that share of an F distribution lies; None without degrees of freedom."""
    if not (dof > 0 and other > 0 and isfinite(dof) and isfinite(other)):
        return None
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if beta_share(dof / 2, other / 2, middle) < share:
            low = middle
        else:
            high = middle
    x = (low + high) / 2
    return float("inf") if x >= 1 else other * x / (dof * (1 - x))
