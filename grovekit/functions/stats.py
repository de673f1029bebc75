"""Special functions from published series, and the local posterior of a branch."""

from __future__ import annotations

import math


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h / a


def incomplete_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: series below a + 1, continued fraction beyond."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi_square_tail(df: float, x: float) -> float:
    return math.exp(-x / 2) if df == 2 else 1 - incomplete_gamma(df / 2, x / 2)


def local_posterior(f1: float, f2: float, f3: float, n: float, prior: float) -> float:
    """The probability that the first of three pairings is the true one, given the shares and a Yule prior rate."""
    if n <= 0:
        return 1 / 3

    def upper(z: float) -> float:
        g = 1 - incomplete_beta(z + 1, n - z + 2 * prior, 1 / 3)
        return g if g > 1.1102230246251565e-16 else 0.0

    def ratio(z: float) -> float:
        """Likelihood of the pairing with share z, relative to the first."""
        g = upper(z)
        if g == 0 and z * 3 < n:
            return 0.0
        log = math.log(2) * (z - f1) + math.lgamma(z + 1) + math.lgamma(n - z + 2 * prior) - math.lgamma(f1 + 1) - math.lgamma(n - f1 + 2 * prior)
        return g * math.exp(log) if log < 700 else (math.inf if f1 < z else 0.0)

    own = upper(f1)
    total = own + ratio(f2) + ratio(f3)
    return own / total if total > 0 and math.isfinite(total) else 0.0


def branch_length(f1: float, n: float, prior: float) -> float:
    """In coalescent units; 0 unless the first share is above a third."""
    share = f1 / (n + 2 * prior) if n + 2 * prior > 0 else 0.0
    return -math.log(1.5 * (1 - share)) if share > 1 / 3 else 0.0


def polytomy_pvalue(f1: float, f2: float, f3: float, n: float) -> float | None:
    """Chi-square test of equal shares, two degrees of freedom; none up to 15 genes."""
    if n <= 15:
        return None
    third = n / 3
    return chi_square_tail(2, sum((f - third) ** 2 for f in (f1, f2, f3)) / third)
