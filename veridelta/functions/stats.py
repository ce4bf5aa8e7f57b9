"""Distributions that Spark lacks, for results of a few rows: Student's t, and the power of a two-sample t test."""

from __future__ import annotations

import math

import numpy as np

#: Quantiles of the standard normal at .975 and .8.
Z_975, Z_80 = 1.959963984540054, 0.8416212335729143


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def regularized_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return regularized_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile_two_sided(alpha: float, df: float) -> float:
    """The t whose two-sided p is alpha."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > alpha:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > alpha else (low, mid)
    return (low + high) / 2


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(-x / math.sqrt(2))


def t_power(shift: float, df: float, critical: float) -> float:
    """P(|T| > critical) for noncentral t, by quadrature over the chi-square scale."""
    nodes, weight = np.polynomial.legendre.leggauss(200)
    spread = math.sqrt(2 * df)
    low, high = max(0.0, df - 12 * spread), df + 14 * spread + 20
    v = low + (nodes + 1) * (high - low) / 2
    density = np.exp((df / 2 - 1) * np.log(v) - v / 2 - df / 2 * math.log(2) - math.lgamma(df / 2)) if df > 0 else v
    root = critical * np.sqrt(v / df)
    tail = _normal_cdf(shift - root) + _normal_cdf(-shift - root)
    return float((weight * density * tail).sum() * (high - low) / 2)


def detectable_effect(n_treatment: int, n_control: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """The standardised difference that a two-sample t test finds with this power; infinite without enough samples."""
    if n_treatment < 2 or n_control < 2:
        return math.inf
    df = n_treatment + n_control - 2
    critical, root = t_quantile_two_sided(alpha, df), math.sqrt(n_treatment * n_control / (n_treatment + n_control))
    low, high = 0.0, 1.0
    while t_power(high * root, df, critical) < power:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_power(mid * root, df, critical) < power else (low, mid)
    return (low + high) / 2


def correlation_mde(n: int) -> float:
    """The rank correlation that n strata can find; infinite for n of 3 and less."""
    return math.inf if n <= 3 else math.tanh((Z_975 + Z_80) / math.sqrt(n - 3))


def psi_verdict(psi: float | None) -> str:
    """STABLE below .1, MODERATE_SHIFT below .25, SIGNIFICANT_DRIFT from there; UNKNOWN without a value."""
    if psi is None or math.isnan(psi):
        return "UNKNOWN"
    return "STABLE" if psi < 0.10 else "MODERATE_SHIFT" if psi < 0.25 else "SIGNIFICANT_DRIFT"
