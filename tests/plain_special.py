"""Plain-Python special functions (textbook series and continued fractions), to compare the column expressions with."""

from __future__ import annotations

import math
from itertools import permutations

TINY = 1e-300
CHI2_1_95 = 3.841458820694124  # Fixed value: 95 % point of chi-square with one degree of freedom.


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _lentz(first: float, terms, limit: int = 100_000) -> float:
    """Value of first + a1/(b1 + a2/(b2 + ...)) for the (a, b) pairs of ``terms``."""
    value = first or TINY
    c, d = value, 0.0
    for step, (a, b) in enumerate(terms):
        d = 1.0 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-16 or step > limit:
            break
    return value


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail of chi-square, accurate far below 1e-16 (log scale throughout)."""
    if x <= 0:
        return 1.0
    a, x = df / 2.0, x / 2.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(scale))

    def terms():
        n = 0
        while True:
            n += 1
            yield -n * (n - a), x + 2.0 * n + 1.0 - a

    return math.exp(scale - math.log(_lentz(x + 1.0 - a, terms())))


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_ratio(b, a, 1.0 - x)

    def terms():
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    log_front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(log_front) / (a * _lentz(1.0, terms()))


def _rank_difference_tail(s: float, n: int, upper: bool) -> float:
    """P(S >= s) (or P(S < s)) for S, the sum of squared rank differences of n items."""
    largest = n * (n * n - 1) / 3.0
    s += s % 2  # S itself is always even
    if s <= 0:
        return 1.0 if upper else 0.0
    if s > largest:
        return 0.0 if upper else 1.0
    if n <= 9:
        base = range(n)
        hits = sum(1 for p in permutations(base) if sum((i - v) ** 2 for i, v in zip(base, p)) >= s)
        tail = hits / math.factorial(n)
        return tail if upper else 1.0 - tail
    # The published Edgeworth series coefficients (AS 89).
    b = 1.0 / n
    x = (6.0 * (s - 1.0) * b / (n * n - 1.0) - 1.0) * math.sqrt(1.0 / b - 1.0)
    y = x * x
    inner = 0.0072 - 0.0831 * b + y * b * (0.0131 - 0.00046 * y)
    inner = 0.0879 + 0.0151 * b - y * inner
    u = x * b * (0.2274 + b * (0.2531 + 0.1745 * b) + y * (-0.0758 + b * (0.1033 + 0.3932 * b) - y * b * inner))
    correction = u / math.exp(y / 2.0)
    normal = 0.5 * math.erfc(x / math.sqrt(2.0)) if upper else 0.5 * math.erfc(-x / math.sqrt(2.0))
    return min(1.0, max(0.0, normal + (correction if upper else -correction)))


def spearman_p(rho: float, n: int, ties: bool) -> float:
    """Two-sided p-value of a rank correlation: Edgeworth series, or Student's t with ties."""
    if n < 3 or rho != rho:
        return math.nan
    if ties or n > 1290:
        if abs(rho) >= 1.0:
            return 0.0
        t2 = rho * rho * (n - 2) / (1.0 - rho * rho)
        return beta_ratio((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + t2))
    middle = (n**3 - n) / 6.0
    s = middle * (1.0 - rho)
    if s > middle:
        tail = _rank_difference_tail(round(s - 1.0), n, upper=True)
    else:
        tail = _rank_difference_tail(round(s) + 2.0, n, upper=False)
    return min(1.0, 2.0 * tail)


def _excess(observed: float, expected: float) -> float:
    return observed * math.log(observed / expected) if observed else 0.0


def _deviance(beta: float, a: float, b: float, a0: float, b0: float) -> float:
    """Likelihood-ratio deviance of log odds ratio ``beta`` with the intercept profiled out."""
    n, n0, s, r = a + b, a0 + b0, a + a0, math.exp(beta)
    quad, lin = r * (n + n0 - s), n0 + n * r - s * (1.0 + r)
    root = math.sqrt(lin * lin + 4.0 * quad * s)
    odds0 = 2.0 * s / (lin + root) if lin > 0 else (root - lin) / (2.0 * quad)
    p0, p1 = odds0 / (1.0 + odds0), odds0 * r / (1.0 + odds0 * r)
    return 2.0 * (
        _excess(a0, n0 * p0) + _excess(b0, n0 * (1 - p0)) + _excess(a, n * p1) + _excess(b, n * (1 - p1))
    )


def _intercept_deviance(alpha: float, a0: float, b0: float) -> float:
    n0, p0 = a0 + b0, 1.0 / (1.0 + math.exp(-alpha))
    return 2.0 * (_excess(a0, n0 * p0) + _excess(b0, n0 * (1 - p0)))


def _limits(deviance, centre: float, step: float) -> tuple[float, float]:
    found = []
    for sign in (-1.0, 1.0):
        inside, outside = 0.0, step
        while deviance(centre + sign * outside) < CHI2_1_95:
            inside, outside = outside, 2.0 * outside
        for _ in range(200):
            middle = (inside + outside) / 2.0
            if middle in (inside, outside):
                break
            if deviance(centre + sign * middle) < CHI2_1_95:
                inside = middle
            else:
                outside = middle
        found.append(centre + sign * (inside + outside) / 2.0)
    return found[0], found[1]


def profile_interval(a: float, b: float, a0: float, b0: float, intercept: bool) -> tuple[float, float]:
    """95 % profile-likelihood limits of an odds ratio (or of the baseline odds)."""
    cells = (a0, b0) if intercept else (a, b, a0, b0)
    if min(cells) <= 0:
        return math.nan, math.nan
    step = 2.0 * math.sqrt(sum(1.0 / c for c in cells))
    if intercept:
        low, high = _limits(lambda v: _intercept_deviance(v, a0, b0), math.log(a0 / b0), step)
    else:
        low, high = _limits(lambda v: _deviance(v, a, b, a0, b0), math.log(a * b0 / (b * a0)), step)
    return math.exp(low), math.exp(high)
