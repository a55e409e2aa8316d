"""Distributions, paired tests, pooling and resamples against brute force."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.functions import special
from graphlens.operators import stats


def column(spark, rows, kinds, value):
    df = spark.createDataFrame(rows, kinds).coalesce(1)
    return [r[0] for r in df.select(value).collect()]


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.0, 3.7, 10.0, 123.5, 1e4, 1e7]
    got = column(spark, [(x,) for x in xs], "x double", special.log_gamma(F.col("x")))
    assert all(math.isclose(a, math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12) for a, x in zip(got, xs, strict=True))


def binomial(k, n):
    i = np.arange(k + 1, dtype=float)
    terms = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i]) - n * math.log(2)
    return float(np.exp(terms).sum())


def test_binomial_tails_of_any_size(spark):
    cases = [(0, 1), (1, 1), (0, 5), (2, 7), (7, 7), (40, 100), (5_010, 10_020), (9_900, 20_000), (99_700, 200_000), (4_998_000, 10**7)]
    got = column(spark, cases, "k long, n long", special.binomial_tail(F.col("k"), F.col("n")))
    assert all(abs(a - binomial(k, n)) < 1e-6 for a, (k, n) in zip(got, cases, strict=True)), got


def student(t, v):
    """The density of t integrated in u, where t = sqrt(v) tan u."""
    if v > 10**5:
        return math.erfc(abs(t) / math.sqrt(2)) + (t**3 + t) / (2 * v) * math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    u = np.linspace(0, math.atan(abs(t) / math.sqrt(v)), 200_001)
    y = np.cos(u) ** (v - 1)
    area = float((y[1:] + y[:-1]).sum() * (u[1] - u[0]) / 2)
    return 1 - 2 * area * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)


def test_student_p(spark):
    cases = [(0.0, 3), (1.0, 1), (12.7062, 1), (2.5, 4), (-3.0, 30), (1.96, 1000), (2.2, 10**7), (0.3, 10**7)]
    got = column(spark, [(float(t), v) for t, v in cases], "t double, v long", special.student_p(F.col("t"), F.col("v")))
    assert all(abs(a - student(t, v)) < 1e-6 for a, (t, v) in zip(got, cases, strict=True)), got
    assert column(spark, [(None, 3), (1.0, 0)], "t double, v long", special.student_p(F.col("t"), F.col("v"))) == [None, None]


def test_normal_p(spark):
    zs = [0.0, 0.1, 1.0, 1.959964, -2.5, 6.0, 9.0, 40.0]
    got = column(spark, [(z,) for z in zs], "z double", special.normal_p(F.col("z")))
    assert all(abs(a - math.erfc(abs(z) / math.sqrt(2))) < 1e-12 for a, z in zip(got, zs, strict=True))


def test_mcnemar_beyond_ten_thousand_pairs(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") < 15_200, 1 - F.col("id") % 2).otherwise(0).alias("b"))
    r = stats.mcnemar(df).first()
    n10, n01 = r["n10"], r["n01"]
    assert n10 + n01 > 10_000 and abs(r["p_exact"] - min(1, 2 * binomial(min(n10, n01), n10 + n01))) < 1e-6


def wilcoxon(d):
    d = np.array([x for x in d if x])
    n = len(d)
    size = np.abs(d)
    rank = np.array([((size < x).sum() + 1 + (size <= x).sum()) / 2 for x in size])
    plus, minus = rank[d > 0].sum(), rank[d < 0].sum()
    return n, rank, plus, minus


def test_signed_rank_exact(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for n in (1, 2, 5, 8, 12):
        d = [rng.choice((-1, 1)) * (i + rng.random() * 0.4) for i in range(1, n + 1)]
        rows += [(f"n{n}", x, 0.0) for x in d]
        _, rank, plus, minus = wilcoxon(d)
        low = min(plus, minus)
        want[f"n{n}"] = min(1.0, 2 * sum(sum(r for r, s in zip(rank, signs, strict=True) if s) <= low for signs in product((0, 1), repeat=n)) / 2**n)
    rows += [("zeros", 1.0, 1.0)] * 3 + [(None, 3.0, 1.0)]
    got = {r["g"]: r for r in stats.signed_rank(spark.createDataFrame(rows, "g string, a double, b double"), "g").collect()}
    assert all(math.isclose(got[k]["p"], v) for k, v in want.items()) and got["zeros"]["p"] == 1.0 and got["zeros"]["n_zero"] == 3 and got[None]["n"] == 1


def test_signed_rank_with_ties(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(-4, 5) / 2, 0.0) for g in ("x", "y") for _ in range(300 if g == "x" else 60)]
    got = {r["g"]: r for r in stats.signed_rank(spark.createDataFrame(rows, "g string, a double, b double").repartition(5), "g").collect()}
    for g in ("x", "y"):
        n, _, plus, minus = wilcoxon([a for k, a, _ in rows if k == g])
        ties = sum(c**3 - c for c in np.unique(np.abs([a for k, a, _ in rows if k == g and a]), return_counts=True)[1])
        z = (plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert (got[g]["n"], got[g]["w_plus"], got[g]["w_minus"]) == (n, plus, minus) and abs(got[g]["p"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-9


def pooled(points):
    blocks = []
    for c, s, m in points:
        blocks.append([s, m, [c]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, m2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + m2, blocks[-1][2] + c2]
    return {c: s / m for s, m, cs in blocks for c in cs}


def test_isotonic_of_many_confidences(spark):
    rng = random.Random(4)
    rows = [(c, int(rng.random() < c)) for c in (rng.random() for _ in range(100_000))]
    df = spark.createDataFrame(rows, "conf double, y int").cache()
    at = {}
    for c, y in rows:
        s, m = at.get(c, (0, 0))
        at[c] = (s + y, m + 1)
    want = pooled(sorted((c, s, m) for c, (s, m) in at.items()))
    assert len(want) > 99_000
    for parts in (1, 4, 16):
        got = {r["conf"]: r["fit"] for r in stats.isotonic(df, "conf", "y", parts).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[c], want[c]) for c in want)
    assert stats.isotonic(df.limit(0), "conf", "y").count() == 0


@pytest.mark.parametrize("rows", [[(i / 100, 1) for i in range(100)], [(i / 100, int(i < 50)) for i in range(100)], [(i / 100, int(i >= 50)) for i in range(100)]])
def test_isotonic_shapes(spark, rows):
    got = {r["conf"]: r["fit"] for r in stats.isotonic(spark.createDataFrame(rows, "conf double, y int"), "conf", "y", 5).collect()}
    assert got == pooled([(c, y, 1) for c, y in rows])


def test_poisson_counts(spark):
    for m in (1, 7, 30, 31, 5000):
        h = F.sha2(F.concat(F.lit(f"{m}|"), F.col("id").cast("string")), 256)
        df = spark.range(20_000).select(stats.poisson(F.lit(m), stats.uniform(h, 1), stats.uniform(h, 14)).cast("double").alias("w"))
        r = df.agg(F.avg("w").alias("mean"), F.var_samp("w").alias("var")).first()
        assert abs(r["mean"] - m) < 4 * math.sqrt(m / 20_000) and abs(r["var"] / m - 1) < 0.06


def test_shared_resamples_of_shares(spark):
    rng = random.Random(5)
    rows = [("g", a, a * b) for a, b in ((rng.choice((0.5, 1.0, 0.25)), rng.choice((0.0, 0.5, 1.0))) for _ in range(900))]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    shares = {"half": (F.col("a") / 2, F.col("a")), "part": (F.col("b"), F.col("a")), "none": (F.col("b"), F.col("n") * 0)}
    got = {r["share"]: r for r in stats.share_bootstrap(df, "g", shares, ["a", "b"], 500).collect()}
    assert (got["half"]["estimate"], got["half"]["lo"], got["half"]["hi"]) == (0.5, 0.5, 0.5)  # one resample for both sums
    x = np.array([r[1:] for r in rows])
    pick = np.random.default_rng(1).integers(0, 900, (2000, 900))
    v = np.sort(x[pick, 1].sum(1) / x[pick, 0].sum(1))
    assert abs(got["part"]["lo"] - v[50]) < 0.01 and abs(got["part"]["hi"] - v[1950]) < 0.01 and got["none"]["estimate"] is None and got["none"]["lo"] is None
    again = {r["share"]: r for r in stats.share_bootstrap(df.repartition(7), "g", shares, ["a", "b"], 500).collect()}
    assert again == got
