"""Special functions of the significance tests as column expressions.

Spark SQL has no erfc, incomplete gamma or beta function. Each is written as a finite sum or continued fraction over
``sequence`` and ``aggregate``, so the tests stay in the JVM. How many terms are taken follows from the arguments,
never from a limit on the work; every formula is good to about 1e-13 in its result, in the far tails too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 95 % point of chi-square with one degree of freedom.
CHI2_1_95 = 3.841458820694124
# Fixed value: up to this many items the published test of a rank correlation is exact, above it a series (AS 89).
EXACT_ITEMS = 9
# Fixed value: above this many items the published test uses Student's t.
SERIES_ITEMS = 1290

LN_PI = math.log(math.pi)


def _steps(first: Column | int, last: Column) -> Column:
    """first, first + 1, ..., last; empty if last is smaller."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: the power series of erf up to 1.5, the continued fraction beyond."""
    square = x * x
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * 2 * square / (2 * k + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * square / (2 * k + 1)).alias("total"),
        ),
    )["total"]
    fraction = F.aggregate(F.sequence(F.lit(150), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / 2.0 / acc)
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * series
    return F.when(x < 1.5, near).otherwise(F.exp(-square) / (math.sqrt(math.pi) * fraction))


def normal_p_value(z: Column | str) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    z = F.col(z) if isinstance(z, str) else z
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi_square_log_p(statistic: Column | str, df: Column | str) -> Column:
    """Natural log of the upper tail of chi-square with a whole number of degrees of freedom.

    The tail is a finite sum of Poisson-like terms (and erfc, for odd numbers), added on the log scale. NULL without a
    statistic or degrees of freedom; 0 for statistics not above 0.
    """
    statistic = F.col(statistic) if isinstance(statistic, str) else statistic
    df = (F.col(df) if isinstance(df, str) else df).cast("int")
    x, odd = statistic / 2, df % 2 == 1
    offset = F.when(odd, 0.5).otherwise(0.0)
    terms = F.floor(df / F.lit(2)).cast("int")
    first = F.when(odd, F.ln(x) / 2 - (0.5 * LN_PI - math.log(2.0))).otherwise(F.lit(0.0)) - x
    total = F.aggregate(
        _steps(1, terms - 1),
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] + F.ln(x / (k + offset))).alias("term"),
            _log_add(acc["total"], acc["term"] + F.ln(x / (k + offset))).alias("total"),
        ),
    )["total"]
    # log erfc(sqrt(x)) from the same continued fraction, which is exact enough for odd tails from 1.5 on
    root = F.sqrt(x)
    fraction = F.aggregate(F.sequence(F.lit(150), F.lit(1), F.lit(-1)), root, lambda acc, k: root + k / 2.0 / acc)
    rest = F.when(root < 1.5, F.ln(erfc(root))).otherwise(-x - 0.5 * LN_PI - F.ln(fraction))
    tail = F.when(~odd, total).when(df == 1, rest).otherwise(_log_add(total, rest))
    known = statistic.isNotNull() & ~F.isnan(statistic) & (df > 0)
    return F.when(known, F.when(statistic <= 0, 0.0).otherwise(F.least(F.lit(0.0), tail)))


def chi_square_p_value(statistic: Column | str, df: Column | str) -> Column:
    return F.exp(chi_square_log_p(statistic, df))


def _beta_fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    def step(acc: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2))
        return 1 + odd / (1 + even / acc)

    return F.aggregate(F.sequence(terms, F.lit(0), F.lit(-1)), F.lit(1.0), step)


def student_p_value(t_squared: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t: the regularised incomplete beta function with a half as second parameter."""
    a, b = df / 2.0, F.lit(0.5)
    x, y = df / (df + t_squared), t_squared / (df + t_squared)
    odd = df % 2 == 1
    start = F.when(odd, 0.5).otherwise(1.0)
    # gamma(a + 1/2) / gamma(a), as a product from gamma(1) / gamma(1/2) or gamma(3/2) / gamma(1)
    first = F.when(odd, -0.5 * LN_PI).otherwise(0.5 * LN_PI - math.log(2.0))
    ratio = F.aggregate(
        _steps(0, (a - start - 1).cast("int")), first, lambda acc, i: acc + F.ln((start + i + 0.5) / (start + i))
    )
    front = F.exp(a * F.ln(x) + b * F.ln(y) + ratio - 0.5 * LN_PI)
    terms = (100 + F.ceil(20 * F.sqrt(df.cast("double")))).cast("int")  # the fraction converges in O(sqrt(df)) steps
    direct = front / (a * _beta_fraction(a, b, x, terms))
    other = 1 - front / (b * _beta_fraction(b, a, y, terms))
    return F.when(t_squared == 0, 1.0).when(x <= (a + 1) / (a + b + 2), direct).otherwise(other)


@lru_cache
def _exact_tails(n: int) -> list[float]:
    """P(S >= 0), P(S >= 2), ... for S, the sum of squared rank differences of n items in random order."""
    counts = {0: Counter({0: 1})}
    for item in range(n):
        grown: dict[int, Counter] = {}
        for taken, sums in counts.items():
            for place in range(n):
                if not taken >> place & 1:
                    into = grown.setdefault(taken | 1 << place, Counter())
                    for s, ways in sums.items():
                        into[s + (item - place) ** 2] += ways
        counts = grown
    sums = counts[(1 << n) - 1]
    return [sum(w for s, w in sums.items() if s >= low) / math.factorial(n) for low in range(0, max(sums) + 1, 2)]


def _rank_difference_tail(s: Column, n: Column, upper: Column) -> Column:
    """P(S >= s) where ``upper``, else P(S < s), for S, the sum of squared rank differences of n items."""
    s = s + s % 2  # S itself is always even
    size = n.cast("double")
    # The published Edgeworth series coefficients (AS 89).
    b = 1.0 / size
    x = (6.0 * (s - 1.0) * b / (size * size - 1.0) - 1.0) * F.sqrt(1.0 / b - 1.0)
    y = x * x
    inner = 0.0072 - 0.0831 * b + y * b * (0.0131 - 0.00046 * y)
    inner = 0.0879 + 0.0151 * b - y * inner
    u = x * b * (0.2274 + b * (0.2531 + 0.1745 * b) + y * (-0.0758 + b * (0.1033 + 0.3932 * b) - y * b * inner))
    correction = u / F.exp(y / 2.0)
    above = erfc(F.abs(x) / math.sqrt(2.0)) / 2
    above = F.when(x < 0, 1 - above).otherwise(above)
    below = erfc(F.abs(x) / math.sqrt(2.0)) / 2
    below = F.when(x > 0, 1 - below).otherwise(below)
    series = F.when(upper, above + correction).otherwise(below - correction)
    series = F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))
    exact = F.lit(None).cast("double")
    for items in range(3, EXACT_ITEMS + 1):
        tails = F.expr(f"array({', '.join(f'{v!r}D' for v in _exact_tails(items))})")
        exact = F.when(n == items, F.get(tails, (s / 2).cast("int"))).otherwise(exact)
    exact = F.when(upper, exact).otherwise(1 - exact)
    tail = F.when(n <= EXACT_ITEMS, exact).otherwise(series)
    none, most = s <= 0, s > size * (size * size - 1) / 3.0
    return F.when(none, F.when(upper, 1.0).otherwise(0.0)).when(most, F.when(upper, 0.0).otherwise(1.0)).otherwise(tail)


def spearman_p_value(rho: Column | str, n: Column | str, ties: Column | str) -> Column:
    """Two-sided p-value of a rank correlation of n items, by the published rules.

    Without ties up to EXACT_ITEMS items are counted out and up to SERIES_ITEMS take the Edgeworth series; with ties or more
    items it is Student's t. NULL below three items or without a correlation.
    """
    rho, n, ties = (F.col(c) if isinstance(c, str) else c for c in (rho, n, ties))
    size = n.cast("double")
    square = rho * rho * (size - 2) / F.greatest(1 - rho * rho, F.lit(1e-300))
    student = F.when(F.abs(rho) >= 1, 0.0).otherwise(student_p_value(square, n - 2))
    middle = (size * size * size - size) / 6.0
    s = middle * (1.0 - rho)
    upper = s > middle
    tail = _rank_difference_tail(F.when(upper, F.bround(s - 1)).otherwise(F.bround(s) + 2), n, upper)
    ranked = F.least(F.lit(1.0), 2 * tail)
    known = rho.isNotNull() & ~F.isnan(rho) & (n >= 3)
    return F.when(known, F.when(ties | (n > SERIES_ITEMS), student).otherwise(ranked))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _excess(observed: Column, expected: Column) -> Column:
    return observed * F.ln(F.try_divide(observed, expected))


#: Steps a limit may take; each halves its bracket or follows the slope, and a settled limit takes none.
LIMIT_STEPS = 120


def _limit(deviance: Callable[[Column], Column], centre: Column, step: Column, sign: Column) -> Column:
    """Where the deviance crosses its 95 % point on one side of the centre, as the log of the limit.

    ``deviance`` gives (deviance, slope) at a point. The root of the deviance is close to a straight line, so Newton steps on
    it settle within a few points; a step out of the bracket is replaced by doubling or halving.
    """
    goal = math.sqrt(CHI2_1_95)

    def moved(acc: Column, at: Column) -> Column:
        inside = at["deviance"] < CHI2_1_95
        ends = F.struct(
            F.when(inside, acc["distance"]).otherwise(acc["low"]).alias("low"),
            F.when(inside, acc["high"]).otherwise(acc["distance"]).alias("high"),
            (acc["distance"] + (goal - at["root"]) * 2 * at["root"] / (sign * at["slope"])).alias("newton"),
        )
        return let(ends, lambda e: next_point(acc, e))

    def next_point(acc: Column, e: Column) -> Column:
        halved = F.when(e["high"] == math.inf, 2 * acc["distance"]).otherwise((e["low"] + e["high"]) / 2)
        chosen = F.when((e["newton"] >= e["low"]) & (e["newton"] <= e["high"]), e["newton"]).otherwise(halved)
        return let(chosen, lambda x: F.struct(
            e["low"].alias("low"), e["high"].alias("high"), x.alias("distance"), (F.abs(x - acc["distance"]) <= 1e-15 * F.abs(x)).alias("settled"),
        ))

    def stepped(acc: Column, _: Column) -> Column:
        at = let(
            deviance(centre + sign * acc["distance"]),
            lambda d: F.struct(d["deviance"].alias("deviance"), d["slope"].alias("slope"), F.sqrt(F.greatest(d["deviance"], F.lit(1e-300))).alias("root")),
        )
        return F.when(acc["settled"], acc).otherwise(let(at, lambda x: moved(acc, x)))

    start = F.struct(
        F.lit(0.0).alias("low"), F.lit(math.inf).alias("high"), step.alias("distance"), F.lit(False).alias("settled")
    )
    return centre + sign * F.aggregate(F.sequence(F.lit(1), F.lit(LIMIT_STEPS)), start, stepped)["distance"]


def profile_limits(a: Column, b: Column, a0: Column, b0: Column, intercept: Column) -> Column:
    """95 % profile-likelihood limits of an odds ratio (of the baseline odds, for the intercept), as a struct.

    The deviance has the intercept profiled out. NULL where a cell is empty.
    """

    def at_odds(c: Column, r: Column, odds: Column) -> Column:
        """Deviance and slope where the baseline has ``odds`` and the row r times as much."""
        rates = F.struct((odds / (1.0 + odds)).alias("p0"), (odds * r / (1.0 + odds * r)).alias("p1"))
        return let(rates, lambda p: F.struct(
            (2.0 * (
                _excess(c["a0"], c["n0"] * p["p0"]) + _excess(c["b0"], c["n0"] * (1 - p["p0"]))
                + F.when(c["intercept"], 0.0).otherwise(_excess(c["a"], c["n"] * p["p1"]) + _excess(c["b"], c["n"] * (1 - p["p1"])))
            )).alias("deviance"),
            (2.0 * F.when(c["intercept"], c["n0"] * p["p0"] - c["a0"]).otherwise(c["n"] * p["p1"] - c["a"])).alias("slope"),
        ))

    def profiled_odds(c: Column, r: Column) -> Column:
        """The baseline's likeliest odds at an odds ratio."""
        quadratic = F.struct((r * (c["n"] + c["n0"] - c["s"])).alias("quad"), (c["n0"] + c["n"] * r - c["s"] * (1.0 + r)).alias("lin"))
        return let(quadratic, lambda q: let(
            F.sqrt(q["lin"] * q["lin"] + 4.0 * q["quad"] * c["s"]),
            lambda root: F.when(q["lin"] > 0, 2.0 * c["s"] / (q["lin"] + root)).otherwise((root - q["lin"]) / (2.0 * q["quad"])),
        ))

    def deviance(c: Column) -> Callable[[Column], Column]:
        def at(x: Column) -> Column:
            by_ratio = lambda r: let(F.when(c["intercept"], r).otherwise(profiled_odds(c, r)), lambda odds: at_odds(c, r, odds))
            return let(F.exp(x), by_ratio)

        return at

    def limits(c: Column) -> Column:
        spread = F.struct(
            F.when(c["intercept"], F.ln(c["a0"] / c["b0"])).otherwise(F.ln(c["a"] / c["b"]) - F.ln(c["a0"] / c["b0"])).alias("centre"),
            (math.sqrt(CHI2_1_95) * F.sqrt(1 / c["a0"] + 1 / c["b0"] + F.when(c["intercept"], 0.0).otherwise(1 / c["a"] + 1 / c["b"]))).alias("step"),
        )
        sides = F.array(F.lit(-1.0), F.lit(1.0))
        return let(spread, lambda w: F.transform(sides, lambda sign: F.exp(_limit(deviance(c), w["centre"], w["step"], sign))))

    cells = F.struct(
        a.alias("a"), b.alias("b"), a0.alias("a0"), b0.alias("b0"), (a + b).alias("n"), (a0 + b0).alias("n0"), (a + a0).alias("s"),
        intercept.alias("intercept"),
    )
    full = (a0 > 0) & (b0 > 0) & (intercept | ((a > 0) & (b > 0)))
    found = F.when(full, let(cells, limits))
    return let(found, lambda ends: F.struct(F.get(ends, F.lit(0)).alias("conf_low"), F.get(ends, F.lit(1)).alias("conf_high")))
