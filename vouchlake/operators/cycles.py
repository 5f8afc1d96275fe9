"""Strong components, cycles, long chains and triangles of reference graphs.

Graphs are edges (src, dst); repeated edges count once and nulls are passed over. No
operator holds all reachable pairs: state is a row for each node or edge, cut by reliable
checkpoints. The rounds grow with the longest chain of references, not with the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.operators import graph
from vouchlake.staging import cut


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges left once nodes without an edge in, or without one out, are taken away
    again and again: none of those lies on a cycle."""
    left = edges
    while True:
        inner = left.select(F.col("src").alias("n")).intersect(left.select(F.col("dst").alias("n")))
        kept = cut(left.join(inner.withColumnRenamed("n", "src"), "src", "left_semi").join(inner.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"))
        if kept.count() == left.count():
            return kept
        left = kept


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches it, itself included."""
    now = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    while True:
        met = edges.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("met"))
        step = cut(now.join(met, "node", "left").select("node", F.greatest("colour", "met").alias("colour"), (F.col("met") > F.col("colour")).alias("moved")))
        now = step.select("node", "colour")
        if step.where("moved").isEmpty():
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of every node that has an edge: the least node with which
    it reaches and is reached.

    After trimming, each node takes the colour of the greatest node that reaches it. The
    nodes of a colour that reach its own node are a component; they leave, and the rest
    is trimmed and coloured again.
    """
    base = cut(_plain(edges))
    nodes = base.select(F.col("src").alias("node")).union(base.select("dst")).distinct()
    done, left = None, _trimmed(base.where("src <> dst"))
    while not left.isEmpty():
        colours = _colours(left)
        ends = left.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inner = cut(ends.where("a = b").select("src", "dst"))
        fresh = cut(colours.where("node = colour").select("node", "colour"))
        found = fresh
        while True:
            back = inner.join(fresh.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            fresh = cut(back.join(found, "node", "left_anti"))
            if fresh.isEmpty():
                break
            found = cut(found.union(fresh))
        done = found if done is None else cut(done.union(found))
        gone = found.select(F.col("node").alias("src"))
        left = _trimmed(cut(left.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")))
    if done is None:
        return nodes.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    named = done.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    known = done.join(named, "colour").select("node", "component", "size")
    return nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node) of every node that reaches itself."""
    own = edges.where("src = dst").select(F.col("src").alias("node"))
    return strong_components(edges).where("size > 1").select("node").union(own).distinct()


def condensed(edges: DataFrame) -> DataFrame:
    """The edges between strong components, as (src, dst) of components: a graph without cycles."""
    of = strong_components(edges).select("node", "component")
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("a")), of.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return _plain(edges).join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def chains(edges: DataFrame) -> DataFrame:
    """(node, chain) of a graph without cycles: the links of the longest chain that ends
    in each node that has an edge. Layers of nodes without an edge in leave one by one."""
    left = cut(_plain(edges))
    nodes = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    layers, level = None, 0
    while not nodes.isEmpty():
        inner = left.select(F.col("dst").alias("node")).distinct()
        first = nodes.join(inner, "node", "left_anti").select("node", F.lit(level).cast("long").alias("chain"))
        layers = cut(first if layers is None else layers.union(first))
        rest = cut(nodes.join(inner, "node", "left_semi"))
        if rest.count() == nodes.count():
            raise ValueError("the graph has a cycle")
        nodes, left, level = rest, cut(left.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")), level + 1
    return nodes.select("node", F.lit(0).cast("long").alias("chain")) if layers is None else layers


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle of the undirected graph, once each.

    Edges are turned from the node of lower degree to the higher one, so that a hub has
    few edges out and no node more than the root of twice the edges.
    """
    pairs = _plain(edges).where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    pairs = cut(pairs)
    degree = pairs.select(F.explode(F.array("x", "y")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    both = pairs.join(degree.select(F.col("n").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("n").alias("y"), F.col("d").alias("dy")), "y")
    up = (F.col("dx") < F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") < F.col("y")))
    turned = cut(both.select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("b")))
    wedges = turned.join(turned.withColumnRenamed("b", "c"), "a").where("b < c")
    closing = turned.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    return wedges.join(closing, ["b", "c"]).select("a", "b", "c")


def shape(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and density of the directed graph; links, triads, triangles
    and transitivity of the undirected one; own loops are left out. Nulls where there are too few nodes."""
    base = _plain(edges).where("src <> dst")
    links = base.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    degree = links.select(F.explode(F.array("x", "y")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    nodes = degree.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).alias("triads"))
    counts = [base.agg(F.count("*").alias("edges")), links.agg(F.count("*").alias("links")), triangles(edges).agg(F.count("*").alias("triangles"))]
    for c in counts:  # a row each
        nodes = nodes.crossJoin(F.broadcast(c))
    return nodes.select(
        "nodes", "edges", F.round(F.try_divide("edges", F.col("nodes") * (F.col("nodes") - 1)), 12).alias("density"),
        "links", "triads", "triangles", F.round(F.try_divide(F.col("triangles") * 3, "triads"), 12).alias("transitivity"),
    )


def ring_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_components(graph._rings(spark, sf_dir))


def nodes_on_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_cycles(graph._rings(spark, sf_dir))


def longest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest chain of strong components that ends in each."""
    return chains(condensed(graph._rings(spark, sf_dir)))


def graph_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers refer to half and to a third of their number, and all to the first."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    e = [c.select(F.col("c_custkey").alias("src"), F.expr(f"{to} AS dst")) for to in ("c_custkey div 2", "c_custkey div 3", "cast(1 AS bigint)")]
    return shape(e[0].union(e[1]).union(e[2]))


_R = """WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 0 UNION SELECT s_suppkey // 20, s_suppkey // 20 * 4 FROM supplier WHERE s_suppkey >= 20),
    r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
    n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    m AS (SELECT node, node AS other FROM n UNION SELECT r.src, r.dst FROM r JOIN r AS b ON b.src = r.dst AND b.dst = r.src),
    k AS (SELECT node, min(other) AS component, count(*) AS size FROM m GROUP BY 1)"""
QUERIES = {f.__name__: f for f in (ring_components, nodes_on_cycles, longest_chains, graph_shape)}
ORACLE_SQL = {
    "ring_components": f"{_R} SELECT node, component, size FROM k",
    "nodes_on_cycles": f"{_R} SELECT src AS node FROM r WHERE src = dst",
    "longest_chains": f"""{_R}, d AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN k a ON a.node = e.src JOIN k b ON b.node = e.dst WHERE a.component <> b.component),
        p AS (SELECT DISTINCT src AS node, 0 AS links FROM d WHERE src NOT IN (SELECT dst FROM d) UNION SELECT d.dst, links + 1 FROM p JOIN d ON d.src = p.node)
        SELECT node, max(links)::BIGINT AS chain FROM p GROUP BY 1""",
    "graph_shape": """WITH e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer UNION SELECT c_custkey, c_custkey // 3 FROM customer UNION SELECT c_custkey, 1 FROM customer),
        d AS (SELECT * FROM e WHERE src <> dst), l AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM d),
        g AS (SELECT count(*) AS n FROM (SELECT x FROM l UNION ALL SELECT y FROM l) GROUP BY x),
        t AS (SELECT count(*) AS n FROM l a JOIN l b ON a.x = b.x AND a.y < b.y JOIN l c ON c.x = a.y AND c.y = b.y),
        s AS (SELECT count(*) AS nodes, sum(n * (n - 1) // 2)::BIGINT AS triads FROM g)
        SELECT nodes, (SELECT count(*) FROM d) AS edges, round((SELECT count(*) FROM d) / (nodes * (nodes - 1))::DOUBLE, 12) AS density, (SELECT count(*) FROM l) AS links, triads,
               t.n AS triangles, round(3.0::DOUBLE * t.n / triads, 12) AS transitivity FROM s, t""",
}
