"""Tail probabilities of the reference distributions, for statistics already aggregated by Spark."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float | None, dof: float) -> float | None:
    if t is None or dof <= 0:
        return None
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def f_sf(f: float | None, d1: float, d2: float) -> float | None:
    if f is None or d1 <= 0 or d2 <= 0:
        return None
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float | None, dof: float) -> float | None:
    if x is None or dof <= 0:
        return None
    return gamma_sf(dof / 2.0, x / 2.0)


def kolmogorov_sf(n: int, d: float) -> float:
    """Chance that the greatest distance of n values from their own continuous distribution function is ``d`` or more.

    Up to 1,000 values the exact law by Marsaglia, Tsang and Wang's matrix power; above, the limit law with Stephens' correction.
    """
    if d <= 0.0:
        return 1.0
    if d >= 1.0:
        return 0.0
    if n > 1000 or n * d * d > 18:
        root = math.sqrt(n)
        x = d * (root + 0.12 + 0.11 / root)
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    matrix = np.tri(m, m, 1)
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[-1, :] -= powers[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** m
    ahead = np.arange(1, m + 1)[:, None] - np.arange(m)[None, :]
    for g in range(2, m + 1):
        matrix[ahead >= g] /= g
    result, scale, left, own = np.eye(m), 0, n, 0
    while left:  # the matrix to the power n, with powers of ten kept apart
        if left & 1:
            result, scale = result @ matrix, scale + own
        matrix, own, left = matrix @ matrix, 2 * own, left >> 1
        for _ in range(2):
            if matrix.max() > 1e140:
                matrix, own = matrix * 1e-140, own + 140
            if result.max() > 1e140:
                result, scale = result * 1e-140, scale + 140
    value = result[k - 1, k - 1]
    for i in range(1, n + 1):
        value *= i / n
        if value < 1e-140:
            value, scale = value * 1e140, scale - 140
    return float(min(1.0, max(0.0, 1.0 - value * 10.0**scale)))
