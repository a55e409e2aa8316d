"""Functions of probability theory as Columns: folds of fixed recurrences, so they stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series of log gamma, in powers 1/x, 1/x^3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def log_gamma(x: Column) -> Column:
    """Natural logarithm of gamma for x > 0, by Stirling's series at x + 8."""
    y = x.cast("double") + 8
    series = sum((F.lit(c) / F.pow(y, F.lit(2.0 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
    rising = sum((F.log(x.cast("double") + i) for i in range(8)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - rising


def beta_regularised(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b > 0 and 0 <= x <= 1.

    Lentz's evaluation of the continued fraction; it converges in some sqrt(max(a, b)) steps on the side
    where x is below the mean, so the other side is 1 - I_(1-x)(b, a).
    """
    a, b, x = (c.cast("double") for c in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    state = F.struct(p.alias("p"), q.alias("q"), y.alias("y"))
    away = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def half(s: Column, e: Column) -> Column:
        d = 1 / away(1 + e * s["d"])
        c = away(1 + e / s["c"])
        return F.struct(s["p"].alias("p"), s["q"].alias("q"), s["y"].alias("y"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def even(s: Column, m: Column) -> Column:
        return half(s, m * (s["q"] - m) * s["y"] / ((s["p"] + 2 * m - 1) * (s["p"] + 2 * m)))

    def odd(s: Column, m: Column) -> Column:
        return half(s, -(s["p"] + m) * (s["p"] + s["q"] + m) * s["y"] / ((s["p"] + 2 * m) * (s["p"] + 2 * m + 1)))

    d0 = 1 / away(1 - (p + q) * y / (p + 1))
    first = F.struct(p.alias("p"), q.alias("q"), y.alias("y"), F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    steps = F.sequence(F.lit(2).cast("long"), F.lit(121).cast("long") + 2 * F.ceil(F.lit(5.0) * F.sqrt(F.greatest(p, q))))
    # step 2m is the even half of round m, step 2m + 1 the odd one
    fraction = F.aggregate(steps, first, lambda s, i: F.when(i % 2 == 0, even(s, F.floor(i / 2).cast("double"))).otherwise(odd(s, F.floor(i / 2).cast("double"))), lambda s: s["h"])
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log1p(-y)) / p
    inner = front * fraction
    value = F.when(swap, 1 - inner).otherwise(inner)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) of n fair coins."""
    return F.when(k >= n, 1.0).otherwise(beta_regularised(n - k, k + 1, F.lit(0.5)))


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t; null without a statistic or a degree of freedom."""
    return F.when(t.isNotNull() & (freedom > 0), beta_regularised(freedom / F.lit(2.0), F.lit(0.5), freedom / (freedom + t * t)))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value, by a series of positive terms; 0 beyond 12."""
    v = F.least(F.abs(z), F.lit(12.0))
    step = lambda s, i: F.struct(s["v"].alias("v"), (s["term"] * s["v"] * s["v"] / (2 * i + 1)).alias("term"), (s["sum"] + s["term"] * s["v"] * s["v"] / (2 * i + 1)).alias("sum"))
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(260)), F.struct(v.alias("v"), v.alias("term"), v.alias("sum")), step, lambda s: s["sum"])
    return F.when(F.abs(z) >= 12, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.lit(2 / math.sqrt(2 * math.pi)) * F.exp(-v * v / 2) * inside))


def signed_rank_p(w: Column, n: Column) -> Column:
    """Two-sided p of the smaller signed-rank sum w of n untied differences: subsets of 1..n by their sum, counted; for n up to 50."""
    size = F.least(n, F.lit(50)).cast("int")
    none = F.transform(F.sequence(F.lit(0), (size * (size + 1) / 2).cast("int")), lambda i: (i == 0).cast("double"))
    ways = F.aggregate(F.sequence(F.lit(1), size), none, lambda acc, k: F.transform(acc, lambda x, i: x + F.when(i >= k, F.get(acc, i - k)).otherwise(0.0)))
    upto = F.aggregate(F.slice(ways, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * upto / F.pow(F.lit(2.0), size))
