"""Special functions without SciPy: quantiles of the normal, t and chi-square laws, incomplete gamma and beta, and limiting laws."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * lead
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / (c if abs(c) > tiny else tiny)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - lead * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return lead * h


def bisect(f, low: float, high: float, steps: int = 200) -> float:
    """Root of a function that grows through zero between low and high."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


@lru_cache(maxsize=None)
def chi2_quantile(p: float, k: float) -> float:
    top = k + 10
    while gamma_p(k / 2, top / 2) < p:
        top *= 2
    return bisect(lambda x: gamma_p(k / 2, x / 2) - p, 0.0, top)


@lru_cache(maxsize=None)
def t_quantile(p: float, k: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, k)
    cdf = lambda t: 1 - 0.5 * beta_i(k / 2, 0.5, k / (k + t * t))
    top = 10.0
    while cdf(top) < p:
        top *= 2
    return bisect(lambda t: cdf(t) - p, 0.0, top)


def bessel_k(nu: float, x: float) -> float:
    """Modified Bessel function of the second kind from its integral over cosh."""
    if x <= 0:
        return math.inf
    u = np.linspace(0.0, math.acosh(1 + 745 / x), 4001)
    f = np.exp(-x * np.cosh(u)) * np.cosh(nu * u)
    return float((f[1:] + f[:-1]).sum() * (u[1] - u[0]) / 2)


def cvm_cdf(z: float, terms: int = 12) -> float:
    """Limiting law of the Cramer-von Mises statistic (Anderson and Darling 1952)."""
    if z <= 0:
        return 0.0
    if z > 5:
        return 1.0
    total = 0.0
    for j in range(terms):
        c = (4 * j + 1) ** 2 / (16 * z)
        if c > 700:
            break
        total += math.exp(math.lgamma(j + 0.5) - math.lgamma(j + 1)) / math.gamma(0.5) * math.sqrt(4 * j + 1) * math.exp(-c) * bessel_k(0.25, c)
    return min(1.0, total / (math.pi * math.sqrt(z)))


def ad_cdf(z: float, terms: int = 12) -> float:
    """Limiting law of the Anderson-Darling statistic, by the series of Anderson and Darling (1954) with its integral in closed quadrature."""
    if z <= 0:
        return 0.0
    w = np.linspace(0.0, 8.0, 4001)
    total = 0.0
    for j in range(terms):
        t = (4 * j + 1) ** 2 * math.pi**2 / (8 * z)
        if t > 700:
            break
        f = np.exp(z / (8 * (1 + w * w)) - w * w * t)
        area = float((f[1:] + f[:-1]).sum() * (w[1] - w[0]) / 2)
        coef = (-1) ** j * math.gamma(j + 0.5) / (math.gamma(0.5) * math.gamma(j + 1)) * (4 * j + 1)
        total += coef * math.exp(-t) * area
    return min(1.0, max(0.0, total * math.sqrt(2 * math.pi) / z))
