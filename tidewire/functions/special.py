"""Special functions in numpy: digamma, incomplete gamma, chi-square quantiles, tails of count distributions."""

from __future__ import annotations

import math

import numpy as np

EULER_GAMMA = 0.5772156649015329


def digamma(x: np.ndarray | float) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - 1 / np.where(low, y, 1), shift)
        y = np.where(low, y + 1, y)
    inv = 1 / (y * y)
    return shift + np.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_sf(x: float, dof: float) -> float:
    return 1 - gamma_p(dof / 2, x / 2)


def chi2_ppf(p: float, dof: float) -> float:
    """Quantile by bisection between bounds that are doubled until they hold it."""
    low, high = 0.0, max(1.0, dof)
    while gamma_p(dof / 2, high / 2) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if gamma_p(dof / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def chi2_quantiles(p: np.ndarray, dof: float) -> np.ndarray:
    """Quantiles of many probabilities at once: halving on the power series of the distribution function."""
    p = np.asarray(p, dtype=float)
    if dof == 2:
        return -2 * np.log1p(-p)
    a = dof / 2
    most = chi2_ppf(float(p.max(initial=0.0)), dof) if len(p) else 0.0
    low, high = np.zeros(len(p)), np.full(len(p), most + 1e-9)
    terms = int(most + 20 * math.sqrt(most + 1) + 30)
    for _ in range(60):
        x = (low + high) / 4
        term = total = np.full(len(p), 1 / a)
        for n in range(1, terms):
            term = term * x / (a + n)
            total = total + term
        below = total * np.exp(a * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(a)) < p
        low, high = np.where(below, 2 * x, low), np.where(below, high, 2 * x)
    return (low + high) / 2


#: Populations from which on probabilities come from logarithms: exact binomials have as many digits as the population has members.
BY_LOGARITHMS = 1_000
_SMALL = np.array([math.lgamma(k + 1) for k in range(256)])


def log_factorial(k: np.ndarray | int) -> np.ndarray:
    """Logarithms of factorials: a table, and Stirling's series beyond it."""
    k = np.asarray(k, dtype=np.int64)
    x = np.maximum(k, 256) + 1.0
    y = 1 / (x * x)
    return np.where(k < 256, _SMALL[np.clip(k, 0, 255)], (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y / 1260)) / x)


def log_hypergeometric(k: np.ndarray, population: int, marked: int, drawn: int) -> np.ndarray:
    """Logarithms of the probabilities of counts that can be."""
    f = log_factorial
    ends = f(np.array([marked, population - marked, drawn, population - drawn, population]))
    return ends[:4].sum() - ends[4] - f(k) - f(marked - k) - f(drawn - k) - f(population - marked - drawn + k)


def hypergeometric_pmf(k: int, population: int, marked: int, drawn: int) -> float:
    if k < max(0, drawn - (population - marked)) or k > min(drawn, marked):
        return 0.0
    if population > BY_LOGARITHMS:
        return float(np.exp(log_hypergeometric(np.array(k), population, marked, drawn)))
    return math.comb(marked, k) * math.comb(population - marked, drawn - k) / math.comb(population, drawn)


def binomial_pmf(k: int, n: int, p: float = 0.5) -> float:
    if not 0 <= k <= n:
        return 0.0
    if n > BY_LOGARITHMS and 0 < p < 1:
        return float(np.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)))
    return math.comb(n, k) * p**k * (1 - p) ** (n - k)
