"""Rank correlations with p-values, all in columns.

Spearman's coefficient with average ranks of ties; its p-value by Student's distribution,
whose tail is an incomplete beta function, evaluated as a continued fraction. Pairs with
a null or NaN on either side are left out, as is a group without pairs; a group whose
values are all the same on one side, or that has fewer than three pairs, has null results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchlake.staging import cut

#: Lanczos' coefficients (g = 7) of the gamma function.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
STEPS, TINY = 400, 1e-300
#: Parts that certificates, and then their pairs, are dealt in.
PARTS = 200


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive number of a half at least."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(series)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function, 0 <= x <= 1, by Lentz's continued fraction."""
    swap = x > (a + 1) / (a + b + 2)
    sides = [F.when(swap, 1 - x).otherwise(x).alias("z"), F.when(swap, b).otherwise(a).alias("p"), F.when(swap, a).otherwise(b).alias("q"), swap.alias("swap")]
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def value(s: Column) -> Column:
        z, p, q = s["z"], s["p"], s["q"]
        front = F.exp(p * F.log(z) + q * F.log1p(-z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p

        def term(k: Column) -> Column:
            m = F.floor(k / 2)
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(k % 2 == 1, odd).otherwise(m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)))

        def step(f: Column, v: Column) -> Column:
            c, d = safe(1 + v / f["c"]), 1 / safe(1 + v * f["d"])
            return F.struct(c.alias("c"), d.alias("d"), (f["h"] * c * d).alias("h"))

        terms = F.transform(F.transform(F.sequence(F.lit(2), F.lit(2 * STEPS + 1)), lambda k: k.cast("double")), term)
        first = 1 / safe(1 - (p + q) * z / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        return _let(front * F.aggregate(terms, start, step, lambda f: f["h"]), lambda v: F.when(s["swap"], 1 - v).otherwise(v))

    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(_let(F.struct(*sides), value))


def student_below(t: Column, freedom: Column) -> Column:
    """The chance that a variable of Student's distribution lies below t."""
    tail = incomplete_beta(freedom / (freedom + t * t), freedom / 2, F.lit(0.5)) / 2
    return _let(tail, lambda v: F.when(t > 0, 1 - v).otherwise(v))


def correlation_p(r: Column, n: Column, alternative: str = "less") -> Column:
    """The p-value of a correlation of n pairs: `less`, `greater` or `two-sided`."""
    free = (n - 2).cast("double")
    below = F.when(r >= 1, F.lit(1.0)).when(r <= -1, F.lit(0.0)).otherwise(student_below(r * F.sqrt(free / ((1 - r) * (1 + r))), free))
    sided = {"less": lambda v: v, "greater": lambda v: 1 - v, "two-sided": lambda v: 2 * F.least(v, 1 - v)}
    return F.when(n > 2, _let(below, sided[alternative]))


def _ranked(counts: DataFrame, side: str) -> DataFrame:
    """(group, side, rank): the average rank of each value of a group, from counted pairs.

    Values are dealt by ranges and ranked inside each range behind the sum of the ranges
    before it, so that no task holds all values of a group.
    """
    values = counts.groupBy("group", F.col(side).alias("v")).agg(F.sum("n").alias("n"))
    dealt = cut(values.repartitionByRange("group", "v").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("group", "part").agg(F.sum("n").alias("n"))
    before = parts.select("group", "part", (F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("group", "part").orderBy("v")) - F.col("n")
    return dealt.withColumn("inside", inside).join(before, ["group", "part"]).select("group", F.col("v").alias(side), (F.col("before") + F.col("inside") + (F.col("n") + 1) / 2).alias(f"{side}_rank"))


def rank_correlations(pairs: DataFrame, alternative: str = "less", support: int = 0) -> DataFrame:
    """(group, n, rho, p) of (group, x, y): groups with fewer than `support` pairs are left out."""
    known = pairs.select("group", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("group is not null and not isnan(x) and not isnan(y) and x is not null and y is not null")
    # dealt before they are counted: where pairs hardly repeat, a few tasks would hold them all
    counts = cut(known.repartition(PARTS, "group", "x", "y").groupBy("group", "x", "y").agg(F.count("*").alias("n")))
    a, b = F.col("x_rank"), F.col("y_rank")
    ranked = counts.join(_ranked(counts, "x"), ["group", "x"]).join(_ranked(counts, "y"), ["group", "y"])
    total = counts.groupBy("group").agg(F.sum("n").alias("all"))
    centred = ranked.join(total, "group").select("group", F.col("n").cast("double").alias("n"), (a - (F.col("all") + 1) / 2).alias("a"), (b - (F.col("all") + 1) / 2).alias("b"))
    product = lambda x, y: F.sum(F.col("n") * F.col(x) * F.col(y))
    sums = centred.groupBy("group").agg(F.sum("n").cast("long").alias("n"), product("a", "b").alias("ab"), product("a", "a").alias("aa"), product("b", "b").alias("bb"))
    rho = F.when(F.col("n") > 2, F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))))
    bounded = F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)))
    kept = sums.where(F.col("n") >= support).select("group", "n", bounded.alias("rho"))
    return kept.select("group", "n", "rho", correlation_p(F.col("rho"), F.col("n"), alternative).alias("p"))


def family_correlations(certs: DataFrame, levels: DataFrame, scores: list[str], support: int = 0) -> DataFrame:
    """(family, score, n, rho, p): levels against scores, family by family, the most supported first.

    `levels` has dgst, family, level (with `eal` for the certificate's own); `certs` has
    dgst and the scores. Families with a score that has no coefficient are left out.
    """
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("y")) for s in scores])).alias("s")
    rows = levels.repartition(PARTS, "dgst").join(certs.repartition(PARTS, "dgst").select("dgst", each), "dgst").select(F.concat_ws("\n", "family", "s.score").alias("group"), F.col("level").alias("x"), F.col("s.y").alias("y"))
    part = F.split("group", "\n")
    found = rank_correlations(rows, "less", support).select(part[0].alias("family"), part[1].alias("score"), "n", "rho", "p")
    whole = found.groupBy("family").agg(F.count("rho").alias("k")).where(F.col("k") == len(scores))
    return found.join(whole, "family", "left_semi")


def requirement_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are certificates: the levels are their lines' numbers, by return flag and
    status as the family; the scores are their price and their lines' greatest quantity."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem")
    most = lines.select(F.col("l_orderkey").alias("dgst"), "l_quantity").repartition(PARTS, "dgst").groupBy("dgst").agg(F.max("l_quantity").alias("most"))
    certs = read("orders").select(F.col("o_orderkey").alias("dgst"), F.col("o_totalprice").alias("price")).repartition(PARTS, "dgst").join(most, "dgst")
    levels = lines.select(F.col("l_orderkey").alias("dgst"), F.concat("l_returnflag", "l_linestatus").alias("family"), F.col("l_linenumber").alias("level"))
    got = family_correlations(certs, levels, ["price", "most"])
    return got.select("family", "score", "n", F.round("rho", 9).alias("rho"), F.round("p", 8).alias("p"))


QUERIES = {"requirement_correlations": requirement_correlations}
#: The tail as an integral of powers of a cosine, by Simpson's rule over 2,000 strips.
ORACLE_SQL = {
    "requirement_correlations": """
        WITH c AS (SELECT o_orderkey AS k, o_totalprice AS price, max(l_quantity) AS most FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
        r AS (SELECT l_returnflag || l_linestatus AS family, 'price' AS score, l_linenumber AS x, price AS y FROM lineitem JOIN c ON k = l_orderkey
              UNION ALL SELECT l_returnflag || l_linestatus, 'most', l_linenumber, most FROM lineitem JOIN c ON k = l_orderkey),
        k AS (SELECT family, score, rank() OVER (PARTITION BY family, score ORDER BY x) + (count(*) OVER (PARTITION BY family, score, x) - 1) / 2e0 AS a,
                     rank() OVER (PARTITION BY family, score ORDER BY y) + (count(*) OVER (PARTITION BY family, score, y) - 1) / 2e0 AS b FROM r),
        s AS (SELECT family, score, count(*) AS n, corr(a, b) AS rho FROM k GROUP BY 1, 2),
        t AS (SELECT *, atan(rho / sqrt(1 - rho * rho)) AS u, exp(lgamma((n - 1) / 2e0) - lgamma((n - 2) / 2e0)) / sqrt(pi()) AS f FROM s),
        p AS (SELECT family, score, 0.5e0 + any_value(f * u) / 6000 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(u * i / 2000), n - 3)) AS p
              FROM t, range(2001) AS g(i) GROUP BY 1, 2)
        SELECT family, score, n, round(rho, 9) AS rho, round(p, 8) AS p FROM s JOIN p USING (family, score)""",
}
