"""Reference graphs: transitive closure, reverse edges, attribute propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.staging import cut

#: Parts that nodes are dealt in where they climb to their tops.
PARTS = 200


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) reachable over ``edges``; a node on a cycle reaches itself.

    A round doubles the length looked at: pairs joined by shorter paths, and pairs joined by
    paths of exactly that length, are put end to end, so that a chain of n links takes log2(n)
    rounds. It ends once a round finds no new pair.
    """
    exact, found = cut(edges.select("src", "dst").distinct()), []
    onward = lambda left, right: left.withColumnRenamed("dst", "mid").join(right.withColumnRenamed("src", "mid"), "mid").select("src", "dst")
    while True:
        known = reduce(DataFrame.union, found) if found else None
        step = exact if known is None else exact.union(onward(known, exact)).distinct().join(known, ["src", "dst"], "left_anti")
        fresh = cut(step)
        if fresh.isEmpty():
            return fresh if known is None else known
        found.append(fresh)
        exact = cut(onward(exact, exact).distinct())


def inherited(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """(node, flag) of every node that some node with the flag reaches; (node, flag)
    pairs spread along the edges from the flagged nodes only."""
    base = edges.select("src", "dst").distinct()
    fresh, known = flagged.select(F.col("node").alias("src"), "flag").distinct(), None
    while True:
        # by sorting: small rounds broadcast, one after the other, would add up in the driver
        step = base.join(fresh.hint("merge"), "src").select(F.col("dst").alias("node"), "flag").distinct()
        fresh = cut(step if known is None else step.join(known.hint("merge"), ["node", "flag"], "left_anti"))
        if fresh.isEmpty():
            return fresh if known is None else known
        known = fresh if known is None else known.union(fresh)
        fresh = fresh.withColumnRenamed("node", "src")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded graph of customers: each refers to one of half its number."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.where("c_custkey > 1").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst"))


def edges_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def closure_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(_edges(spark, sf_dir))


def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("referenced_by"))


def transitive_attribute_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node inherits the flags of the nodes that reach it."""
    flagged = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0").select(F.col("c_custkey").alias("node"), F.col("c_custkey").alias("flag"))
    return inherited(_edges(spark, sf_dir), flagged).groupBy("node").agg(F.count("*").alias("n_inherited"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node weakly connected to it.

    Labels fall along edges and then jump to their label's own label, so that long
    chains take few rounds. Nodes are those that have an edge.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("root"))
        moved = cut(stepped.join(jump, "new").select("node", F.least("new", "root").alias("component"), "old"))
        labels = moved.select("node", "component")
        if moved.where("component <> old").limit(1).count() == 0:
            return labels


def hops_to(edges: DataFrame, target: int) -> DataFrame:
    """(node, hops) of every node that reaches `target`; breadth first, a join a hop."""
    base = edges.select("src", "dst").distinct()
    layers = [edges.sparkSession.range(1).select(F.lit(target).cast("long").alias("node"), F.lit(0).alias("hops"))]
    while True:
        step = base.join(layers[-1].withColumnRenamed("node", "dst"), "dst").select(F.col("src").cast("long").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        known = reduce(DataFrame.union, layers).select("node")
        layers.append(cut(step.join(known, "node", "left_anti")))
        if layers[-1].isEmpty():
            return reduce(DataFrame.union, layers)


def top_parents(parents: DataFrame) -> DataFrame:
    """(node, top) for (node, parent), parents without a row of their own being tops.

    A node takes over its parent's parent, so a chain of n links takes log2(n)
    rounds. A node with several parents has a row for each top; nodes on a cycle
    have none, having no top.
    """
    todo = cut(parents.where("parent is not null and node <> parent").select("node", "parent", F.lit(True).alias("moved")).repartition(PARTS, "node").distinct())
    bound = todo.count()
    for _ in range(max(1, bound).bit_length() + 1):
        link = todo.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        # a parent without a row is a top and stays
        led = todo.where("moved").join(link.hint("merge"), "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved"))
        todo = cut(led.union(todo.where("not moved")).repartition(PARTS, "node").groupBy("node", "parent").agg(F.bool_and("moved").alias("moved")))
        if todo.where("moved").isEmpty():
            break
    return todo.where("not moved").select("node", F.col("parent").alias("top"))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five trees of customers, by the rest of their number."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.where("c_custkey >= 25").select(F.col("c_custkey").alias("src"), F.expr("25 * ((c_custkey div 25) div 2) + c_custkey % 25").alias("dst"))


def connected_components_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_forest(spark, sf_dir))


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_forest(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n_nodes"))


def shortest_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops_to(_edges(spark, sf_dir), 1)


def rollup_to_top_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_parents(_forest(spark, sf_dir).select(F.col("src").alias("node"), F.col("dst").alias("parent")))


def reach(edges: DataFrame) -> DataFrame:
    """(node, n_descendants, n_ancestors) of every node that has an edge."""
    pairs = closure(edges)
    ends = pairs.select(F.col("src").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(pairs.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").cast("long").alias("n_descendants"), F.sum("up").cast("long").alias("n_ancestors"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers refer to half their number, and their twentieth refers to its fourfold."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    half = s.where("s_suppkey > 0").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))
    back = s.select(F.expr("s_suppkey div 20").alias("src"), F.expr("(s_suppkey div 20) * 4").alias("dst")).where("src > 0")
    return half.union(back).distinct()


def reach_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(_edges(spark, sf_dir))


def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at a node over the other nodes; each edge is counted at both its ends."""
    e = _edges(spark, sf_dir)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    total = ends.agg(F.count("*").alias("nodes"))
    return ends.crossJoin(F.broadcast(total)).select("node", "degree", F.round(F.col("degree") / (F.col("nodes") - 1), 8).alias("centrality"))


_E = "(SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 1)"
_C = f"WITH RECURSIVE r AS (SELECT src, dst FROM {_E} UNION SELECT r.src, e.dst FROM r JOIN {_E} e ON r.dst = e.src)"
_F = "(SELECT c_custkey AS src, 25 * ((c_custkey // 25) // 2) + c_custkey % 25 AS dst FROM customer WHERE c_custkey >= 25)"
_T = f"WITH RECURSIVE t AS (SELECT DISTINCT dst AS node, dst AS component FROM {_F} WHERE dst NOT IN (SELECT src FROM {_F}) UNION ALL SELECT e.src, t.component FROM t JOIN {_F} e ON e.dst = t.node)"
QUERIES = {
    f.__name__: f
    for f in (edges_direct, closure_indirect, reverse_edges, transitive_attribute_propagation, connected_components_forest, component_sizes, shortest_hops, rollup_to_top_parent, degree_centrality, reach_counts)
}
ORACLE_SQL = {
    "edges_direct": f"SELECT src, dst FROM {_E}",
    "closure_indirect": f"{_C} SELECT src, dst FROM r",
    "reverse_edges": f"SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS referenced_by FROM {_E} GROUP BY 1",
    "transitive_attribute_propagation": f"{_C} SELECT dst AS node, count(*) AS n_inherited FROM r JOIN customer ON c_custkey = src WHERE c_acctbal < 0 GROUP BY 1",
    "connected_components_forest": f"{_T} SELECT node, component FROM t",
    "component_sizes": f"{_T} SELECT component, count(*) AS n_nodes FROM t GROUP BY 1",
    "shortest_hops": "SELECT c_custkey AS node, cast(length(bin(c_custkey)) - 1 AS integer) AS hops FROM customer WHERE c_custkey >= 1",
    "rollup_to_top_parent": f"{_T} SELECT node, component AS top FROM t WHERE node <> component",
    "degree_centrality": f"""
        SELECT node, count(*) AS degree, round(count(*) / (count(*) OVER () - 1)::double, 8) AS centrality
        FROM (SELECT src AS node FROM {_E} UNION ALL SELECT dst FROM {_E}) GROUP BY 1""",
    "reach_counts": f"""{_C}, a AS (SELECT src AS node, count(*) AS d FROM r GROUP BY 1), b AS (SELECT dst AS node, count(*) AS u FROM r GROUP BY 1)
        SELECT coalesce(a.node, b.node) AS node, coalesce(d, 0) AS n_descendants, coalesce(u, 0) AS n_ancestors FROM a FULL OUTER JOIN b ON a.node = b.node""",
}
