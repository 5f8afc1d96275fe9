"""Communities of reference graphs by modularity: local moves, then contraction.

Edges (src, dst, and weight where there is one, a whole number) are read as undirected;
both directions add up. In each round every node looks at the communities of its
neighbours and moves to the one that gains most, of equals the least; rounds take turns
at moving to lesser and to greater labels, so that two nodes never just swap. Rounds end
when two in turn gain nothing. Communities then become the nodes of a smaller graph, and
so on until nothing moves. Every sum is one of whole numbers, so that reruns and other
partitionings give the same communities. State is a row for each node and each pair of
neighbours; only single numbers come to the driver. Nulls are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.staging import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, w) both ways round; an own loop counts twice, as it has two ends."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1)
    known = edges.select("src", "dst", w.cast("long").alias("w")).where("src is not null and dst is not null and w is not null")
    both = known.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").union(known.select("dst", "src", "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def _quality(links: DataFrame, of: DataFrame) -> int | float:
    """The modularity of (node, community), times the square of the graph's weight."""
    inside = links.join(of.withColumnRenamed("node", "a").withColumnRenamed("community", "ca"), "a").join(of.withColumnRenamed("node", "b").withColumnRenamed("community", "cb"), "b")
    sums = inside.groupBy("ca").agg(F.sum("w").cast("double").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)).cast("double").alias("own"))
    row = sums.agg(F.sum("all").alias("m"), F.sum("own").alias("own"), F.sum(F.col("all") * F.col("all")).alias("squares")).first()
    return row["m"] * row["own"] - row["squares"] if row["m"] else 0


def _moved(links: DataFrame, degree: DataFrame, of: DataFrame, total: int, down: bool) -> DataFrame:
    """(node, community) after one round of moves to lesser (down) or greater labels."""
    sizes = of.join(degree, "node").groupBy("community").agg(F.sum("k").alias("size"))
    near = links.where("a <> b").join(of.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
    own = of.withColumnRenamed("community", "now")
    every = near.union(of.select("node", "community", F.lit(0).cast("long"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
    rated = every.join(sizes, "community").join(degree, "node").join(own, "node")
    here = F.col("community") == F.col("now")
    rest = F.col("size") - F.when(here, F.col("k")).otherwise(0)
    gain = F.col("w").cast("double") * F.lit(float(total)) - F.col("k").cast("double") * rest.cast("double")
    allowed = here | (F.col("community") < F.col("now")) if down else here | (F.col("community") > F.col("now"))
    rated = rated.where(allowed).select("node", "community", "now", gain.alias("gain"), here.alias("here"))
    best = rated.groupBy("node").agg(F.max(F.when(F.col("here"), F.col("gain"))).alias("stay"), F.max_by(F.struct("gain", "community"), F.struct("gain", -F.col("community"))).alias("best"), F.first("now").alias("now"))
    return best.select("node", F.when(F.col("best.gain") > F.col("stay"), F.col("best.community")).otherwise(F.col("now")).alias("community"))


def _level(links: DataFrame) -> DataFrame:
    """(node, community) of one graph, once moves gain nothing."""
    degree = cut(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0]
    of = degree.select("node", F.col("node").alias("community"))
    best, idle, turn = _quality(links, of), 0, 0
    while idle < 2:
        step = cut(_moved(links, degree, of, total, turn % 2 == 0))
        quality = _quality(links, step)
        if quality > best:
            of, best, idle = step, quality, 0
        else:
            idle += 1
        turn += 1
    return of


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) of every node that has an edge: the community's least node."""
    links = cut(adjacency(edges))
    whole = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("at"))
    while not links.isEmpty():
        of = _level(links)
        if of.where("node <> community").isEmpty():
            break
        whole = cut(whole.join(of.withColumnRenamed("node", "at"), "at").select("node", F.col("community").alias("at")))
        ends = links.join(of.withColumnRenamed("node", "a").withColumnRenamed("community", "ca"), "a").join(of.withColumnRenamed("node", "b").withColumnRenamed("community", "cb"), "b")
        links = cut(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    least = whole.groupBy("at").agg(F.min("node").alias("community"))
    return whole.join(least, "at").select("node", "community")


def modularity(edges: DataFrame, of: DataFrame) -> float | None:
    """The modularity of (node, community); null for a graph without edges."""
    links = adjacency(edges)
    total = links.agg(F.sum("w")).first()[0]
    return _quality(links, of) / float(total) ** 2 if total else None


def reference_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in circles of three to nine, each of which refers to all before it in its circle."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey k", "c_custkey div 9 ring", "3 + (c_custkey div 9) % 7 size").where("k % 9 < size")
    before = F.explode(F.sequence(F.col("ring") * 9, F.col("k"))).alias("dst")
    return communities(c.select(F.col("k").alias("src"), before).where("src <> dst"))


QUERIES = {"reference_communities": reference_communities}
ORACLE_SQL = {
    "reference_communities": """
        WITH c AS (SELECT c_custkey AS k, c_custkey // 9 AS ring FROM customer WHERE c_custkey % 9 < 3 + (c_custkey // 9) % 7)
        SELECT k AS node, min(k) OVER (PARTITION BY ring) AS community FROM c QUALIFY count(*) OVER (PARTITION BY ring) > 1""",
}
