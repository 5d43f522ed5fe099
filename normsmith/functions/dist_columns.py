"""Beta, F and t distributions as Column expressions.

The regularised incomplete beta function is its continued fraction, evaluated
from the end over a number of terms that grows with the square root of the
larger parameter (which is what the fraction needs to converge), on the side
of the mean where it converges quickly.  Quantiles come from Newton steps kept
inside a bracket that every step narrows; a step that would leave it becomes a
bisection.  Everything is an expression of the row, so no Python worker runs,
and one row costs the same whatever the number of rows.

A null or impossible parameter gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' series for the gamma function, g = 7, 9 terms.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
STEPS = 60


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def log_gamma(x: Column) -> Column:
    """For x >= 0.5."""
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (x + k)
    t = x + (LANCZOS_G - 0.5)
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(series)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def fraction_terms(a: Column, b: Column) -> Column:
    """Coefficients of the continued fraction of I_x(a, b), last one first."""
    n = (40 + 8 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int")

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(k % 2 == 1, odd).otherwise(even)

    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), term)


def _prepared(a: Column, b: Column) -> Column:
    """What does not depend on x: computed once per row."""
    return F.struct(a.alias("a"), b.alias("b"), log_beta(a, b).alias("lb"), fraction_terms(a, b).alias("ab"),
                    fraction_terms(b, a).alias("ba"))


def _inc(p: Column, x: Column) -> Column:
    """I_x(a, b) from ``_prepared`` values, 0 < x < 1."""
    front = F.exp(p["a"] * F.log(x) + p["b"] * F.log1p(-x) - p["lb"])

    def fold(terms: Column, y: Column) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: t * y / (1 + acc), lambda acc: 1 / (1 + acc))

    low = front * fold(p["ab"], x) / p["a"]
    high = 1 - front * fold(p["ba"], 1 - x) / p["b"]
    return F.when(x < (p["a"] + 1) / (p["a"] + p["b"] + 2), low).otherwise(high)


def _valid(a: Column, b: Column) -> Column:
    return (a >= 0.5) & (b >= 0.5) & (a < 1e15) & (b < 1e15)


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for a, b >= 0.5."""
    inside = let(_prepared(a, b), lambda p: _inc(p, x))
    return F.when(_valid(a, b) & (x <= 0), 0.0).when(_valid(a, b) & (x >= 1), 1.0).when(_valid(a, b) & (x > 0), inside)


def beta_quantile(q: Column, a: Column, b: Column) -> Column:
    """x with I_x(a, b) = q, for a, b >= 0.5 and 0 < q < 1."""

    def search(p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), (p["a"] / (p["a"] + p["b"])).alias("x"))

        def step(s: Column, _: Column) -> Column:
            def narrowed(f: Column) -> Column:
                lo = F.when(f < 0, s["x"]).otherwise(s["lo"])
                hi = F.when(f < 0, s["hi"]).otherwise(s["x"])
                slope = F.exp((p["a"] - 1) * F.log(s["x"]) + (p["b"] - 1) * F.log1p(-s["x"]) - p["lb"])
                return let(F.struct(lo.alias("lo"), hi.alias("hi"), (s["x"] - F.try_divide(f, slope)).alias("n")), inside)

            def inside(n: Column) -> Column:
                ok = (n["n"] > n["lo"]) & (n["n"] < n["hi"])
                x = F.when(ok, n["n"]).otherwise((n["lo"] + n["hi"]) / 2)
                return F.struct(n["lo"].alias("lo"), n["hi"].alias("hi"), x.alias("x"))

            # a bracket of neighbouring numbers has no inside: stay
            done = (s["x"] <= s["lo"]) | (s["x"] >= s["hi"])
            return F.when(done, s).otherwise(let(_inc(p, s["x"]) - q, narrowed))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["x"])

    return F.when(_valid(a, b) & (q > 0) & (q < 1), let(_prepared(a, b), search))


def f_quantile(p: float, d1: Column, d2: Column) -> Column:
    """Quantile of F(d1, d2), from the tail above it."""
    y = beta_quantile(F.lit(1 - p), d2 / 2, d1 / 2)
    return let(y, lambda v: d2 * (1 - v) / (d1 * v))


def t_quantile(p: float, df: Column) -> Column:
    """Upper quantile (p > 0.5) of Student's t."""
    x = beta_quantile(F.lit(2 * (1 - p)), df / 2, F.lit(0.5))
    return let(x, lambda v: F.sqrt(df * (1 - v) / v))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|), from the tail itself."""
    return beta_cdf(df / (df + t * t), df / 2, F.lit(0.5))
