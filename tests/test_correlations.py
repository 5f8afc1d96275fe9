"""P-values against published tables and integrals, coefficients against plain ranks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vouchlake.operators import correlations as co

#: Published quantiles of Student's distribution: degrees of freedom, t, chance below.
TABLE = [(1, 12.7062047364, 0.975), (2, 4.30265272991, 0.975), (5, 2.01504837333, 0.95), (10, 2.76376945811, 0.99), (30, 2.04227245630, 0.975), (120, 1.65765089935, 0.95), (1, 1.0, 0.75)]


def integral(t, free, strips=20000):
    u = math.atan(t / math.sqrt(free))
    f = math.exp(math.lgamma((free + 1) / 2) - math.lgamma(free / 2)) / math.sqrt(math.pi)
    s = sum((1 if i in (0, strips) else 4 if i % 2 else 2) * math.cos(u * i / strips) ** (free - 1) for i in range(strips + 1))
    return 0.5 + f * u / strips / 3 * s


def test_student_tails(spark):
    rows = TABLE + [(n, t, integral(t, n)) for n in (3, 17, 400, 20_000, 500_000) for t in (-3.3, -1.0, 0.2, 1.7, 4.0)]
    df = spark.createDataFrame([(float(n), float(t), p) for n, t, p in rows], "n double, t double, p double")
    for r in df.withColumn("got", co.student_below(F.col("t"), F.col("n"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-8), r


def ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_coefficients_of_groups(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([1, 2, 3, None]), rng.choice([1.5, 2.5, 7.0, float("nan")]) if g < 3 else rng.random()) for g in range(5) for _ in range(60)]
    rows += [(9, 1, 2.0)] * 5 + [(10, 1, 1.0), (10, 2, 2.0)] + [(11, k, float(k)) for k in range(6)] + [(None, 1, 1.0), (12, None, 1.0)]
    got = {r["group"]: r for r in co.rank_correlations(spark.createDataFrame([(*r, "clash") for r in rows], "group int, x int, y double, n string"), "two-sided").collect()}
    for g in {r[0] for r in rows} - {None, 12}:
        pairs = [(x, y) for k, x, y in rows if k == g and x is not None and y == y]
        a, b = ranks([x for x, _ in pairs]), ranks([y for _, y in pairs])
        n, ma, mb = len(pairs), sum(a) / len(a), sum(b) / len(b)
        aa, bb = sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b)
        assert got[g]["n"] == n
        if n < 3 or not aa or not bb:
            assert got[g]["rho"] is None and got[g]["p"] is None
            continue
        rho = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(aa * bb)
        assert got[g]["rho"] == pytest.approx(rho, abs=1e-9)
        if abs(rho) < 1 - 1e-12:
            below = integral(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
            assert got[g]["p"] == pytest.approx(2 * min(below, 1 - below), abs=1e-8)
    assert 12 not in got and got[11]["rho"] == pytest.approx(1.0)
