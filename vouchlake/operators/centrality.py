"""Centralities of reference graphs: influence, closeness, betweenness.

Closeness and betweenness keep every reachable pair, as the measures are defined; they suit
graphs whose nodes reach few others. Betweenness goes back over the pairs, farthest first.
Loops (a node referring to itself) count for influence only. No edges give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.operators.graph import _edges
from vouchlake.staging import cut


def influence(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, influence): eigenvector centrality over incoming edges, of unit length.

    Power iteration with the node's own value added, from equal values; a round is one join and
    one aggregation. Ends once the values move by less than nodes * tolerance; raises after `rounds`.
    """
    base = cut(edges.select("src", "dst").distinct())
    nodes = cut(base.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("influence", F.lit(0.0))
    now = nodes.withColumn("x", F.lit(1.0 / n))
    for _ in range(rounds):
        sent = base.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "x", F.lit(0.0).alias("old"))
        summed = cut(sent.union(now.select("node", "x", F.col("x").alias("old"))).groupBy("node").agg(F.sum("x").alias("x"), F.sum("old").alias("old")))
        length = summed.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        moved = summed.agg(F.sum(F.abs(F.col("x") / length - F.col("old")))).first()[0]
        now = summed.select("node", (F.col("x") / length).alias("x"))
        if moved < n * tolerance:
            return now.withColumnRenamed("x", "influence")
    raise ValueError(f"no fixed point within {rounds} rounds")


def _layers(edges: DataFrame) -> list[DataFrame]:
    """(src, dst, hops, paths) of the pairs one hop apart, two hops apart and so on; the last layer is empty.

    Joins are by sorting: a small layer broadcast in each round would pass through the driver.
    """
    base = edges.where("src <> dst").select("src", "dst").distinct()
    layers = [cut(base.select("src", "dst", F.lit(1).alias("hops"), F.lit(1).cast("long").alias("paths")))]
    while not layers[-1].isEmpty():
        step = layers[-1].withColumnRenamed("dst", "mid").join(base.select(F.col("src").alias("mid"), "dst").hint("merge"), "mid").where("src <> dst")
        step = step.groupBy("src", "dst").agg(F.first("hops").alias("hops"), F.sum("paths").alias("paths")).select("src", "dst", (F.col("hops") + 1).alias("hops"), "paths")
        known = reduce(DataFrame.union, layers).select("src", "dst")
        layers.append(cut(step.join(known.hint("merge"), ["src", "dst"], "left_anti")))
    return layers


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(src, dst, hops, paths): length and number of shortest paths of every reachable pair of
    different nodes; breadth first from all nodes at once, a join a hop."""
    return reduce(DataFrame.union, _layers(edges))


def _with_total(df: DataFrame, edges: DataFrame) -> DataFrame:
    total = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count("*").alias("nodes"))
    return df.crossJoin(F.broadcast(total))  # one row


def closeness(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(node, closeness): nodes that reach it over their summed hops, times their share of the others."""
    near = (shortest_paths(edges) if paths is None else paths).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.sum("hops").alias("hops"))
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(near, "node", "left")
    share = F.col("n") / F.col("hops") * F.col("n") / (F.col("nodes") - 1)
    return _with_total(every, edges).select("node", F.coalesce(share, F.lit(0.0)).alias("closeness"))


def betweenness(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(node, betweenness): share of the shortest paths between other nodes that run over it,
    summed over pairs, over the number of ordered pairs of other nodes."""
    if paths is None:
        layers = _layers(edges)
    else:
        farthest = paths.agg(F.max("hops")).first()[0] or 0
        layers = [paths.where(F.col("hops") == h) for h in range(1, farthest + 1)] or [paths]
    back = edges.where("src <> dst").select(F.col("src").alias("mid"), "dst").distinct()
    # from the farthest pairs inwards: what lies behind a node, as seen from a source, is shared out among the nodes before it
    after, shares = layers[-1].select("src", "dst", "paths", F.lit(0.0).alias("behind")), []
    for layer in reversed(layers[:-1]):
        handed = after.join(back.hint("merge"), "dst").groupBy("src", F.col("mid").alias("dst")).agg(F.sum((1 + F.col("behind")) / F.col("paths")).alias("each"))
        after = cut(layer.join(handed.hint("merge"), ["src", "dst"], "left").select("src", "dst", "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("behind")))
        shares.append(after.select(F.col("dst").alias("node"), "behind"))
    share = reduce(DataFrame.union, shares or [after.select(F.col("dst").alias("node"), "behind")]).groupBy("node").agg(F.sum("behind").alias("share"))
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(share, "node", "left")
    pairs = (F.col("nodes") - 1) * (F.col("nodes") - 2)
    return _with_total(every, edges).select("node", F.when(pairs > 0, F.coalesce("share", F.lit(0.0)) / pairs).otherwise(0.0).alias("betweenness"))


def closeness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closeness(_edges(spark, sf_dir)).withColumn("closeness", F.round("closeness", 8))


def betweenness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return betweenness(_edges(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 10))


def reuse_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Influence of nations by the nations of the suppliers whose parts their suppliers' lines hold."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    e = s.where("s_suppkey > 1").select(F.col("s_nationkey").alias("src"), F.expr("s_suppkey div 2").alias("s_suppkey"))
    return influence(e.join(s, "s_suppkey").select("src", F.col("s_nationkey").alias("dst"))).withColumn("influence", F.round("influence", 4))


QUERIES = {f.__name__: f for f in (closeness_centrality, betweenness_centrality, reuse_influence)}
_N = "(SELECT c_custkey AS node FROM customer WHERE c_custkey > 0)"
_UP = """WITH RECURSIVE up AS (SELECT c_custkey AS src, c_custkey // 2 AS dst, 1 AS hops FROM customer WHERE c_custkey > 1 UNION ALL SELECT src, dst // 2, hops + 1 FROM up WHERE dst > 1)"""
# in a tree one path leads up, and a node lies between those below it and those above it
ORACLE_SQL = {
    "closeness_centrality": f"""{_UP}, t AS (SELECT dst, count(*) AS n, sum(hops) AS h FROM up GROUP BY 1)
        SELECT node, round(coalesce(n * 1e0 / h * n / ((SELECT count(*) FROM {_N}) - 1), 0), 8) AS closeness FROM {_N} LEFT JOIN t ON dst = node""",
    "betweenness_centrality": f"""{_UP}, below AS (SELECT dst AS node, count(*) AS n FROM up GROUP BY 1), above AS (SELECT src AS node, count(*) AS n FROM up GROUP BY 1), m AS (SELECT count(*) * 1e0 AS n FROM {_N})
        SELECT x.node, round(coalesce(b.n * a.n, 0) / ((SELECT n FROM m) - 1) / ((SELECT n FROM m) - 2), 10) AS betweenness FROM {_N} x LEFT JOIN below b ON b.node = x.node LEFT JOIN above a ON a.node = x.node""",
}
