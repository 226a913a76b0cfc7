"""Tail probabilities of the chi-square, F and t distributions.

Scalar helpers for the driver: every statistic is computed on Spark, only
its tail probability is evaluated here.  Regularised incomplete gamma and
beta functions by series / continued fraction (modified Lentz).
"""

from __future__ import annotations

import math

_EPS = 1e-15
_TINY = 1e-300
_MAX_IT = 10_000


def _gamma_series(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x) by its series."""
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(_MAX_IT):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_cf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) by continued fraction."""
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_IT):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x) = 1 - P(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return _gamma_cf(a, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, 1 / (1 + d1 / (1 + d2 / (1 + ...))) with
    d(2m) = m (b - m) x / ((a + 2m - 1)(a + 2m)) and d(2m+1) = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1))
    (NIST Digital Library of Mathematical Functions, 8.17.22).

    Evaluated from the inside out, with twice as many terms until the value stands still."""
    def partial(terms: int) -> float:
        tail = 1.0
        for n in range(terms, 0, -1):
            m = n // 2
            if n % 2:
                d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            tail = 1.0 + d / tail
        return 1.0 / tail

    terms, value = 32, partial(16)
    while terms <= 1 << 16:
        previous, value = value, partial(terms)
        if abs(value - previous) <= 1e-15 * abs(value):
            break
        terms *= 2
    return value


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _beta_fraction(a, b, x) / a
    return 1.0 - bt * _beta_fraction(b, a, 1.0 - x) / b


def chi2_sf(x: float, k: float) -> float:
    """P(X > x) for chi-square with k degrees of freedom."""
    if x is None or k <= 0 or math.isnan(x):
        return float("nan")
    return gamma_q(k / 2.0, x / 2.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(X > f) for the F distribution (d1, d2)."""
    if f is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_sf_two_sided(t: float, df: float) -> float:
    """P(|X| > |t|) for Student's t with df degrees of freedom."""
    if t is None or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return beta_i(df / 2.0, 0.5, df / (df + t * t))
