"""Connected components by contraction: every round merges nodes and drops edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchlake.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp): the least id of each node's component, for edges (a, b).

    A round sends each node to the lowest of its neighbours by hash, and once
    more to that one's lowest, then rewrites the edges to where their ends went;
    loops and repeats fall away. Each round keeps its moves, which are applied
    in turn at the end. Empty input gives an empty result.
    """

    def turned(e: DataFrame) -> DataFrame:
        a_first = F.xxhash64("a") < F.xxhash64("b")
        low, high = F.when(a_first, F.col("a")).otherwise(F.col("b")), F.when(a_first, F.col("b")).otherwise(F.col("a"))
        return e.where("a <> b").select(low.alias("a"), high.alias("b")).distinct()

    live, moves = scratch.cut(turned(edges), f"{name}-0"), []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("id"), F.col("a").alias("up")).union(live.select("b", "a"))
        up = ends.groupBy("id").agg(F.min_by("up", F.xxhash64("up")).alias("up"))
        step = scratch.cut(up, f"{name}-up-{len(moves)}")
        above = step.select(F.col("id").alias("up"), F.col("up").alias("top"))
        move = scratch.cut(step.join(above, "up").select("id", F.col("top").alias("up")), f"{name}-move-{len(moves)}")
        scratch.drop(f"{name}-up-{len(moves)}")
        to_a, to_b = move.select(F.col("id").alias("a"), F.col("up").alias("na")), move.select(F.col("id").alias("b"), F.col("up").alias("nb"))
        after = live.join(to_a, "a").join(to_b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
        moves.append(move)
        live = scratch.cut(turned(after), f"{name}-{len(moves)}")
        scratch.drop(f"{name}-{len(moves) - 1}")
    if not moves:
        return live.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    at = moves[0]
    for move in moves[1:]:
        then = move.select(F.col("id").alias("up"), F.col("up").alias("top"))
        at = at.join(then, "up", "left").select("id", F.coalesce("top", "up").alias("up"))
    at = scratch.cut(at, f"{name}-at")
    least = at.groupBy("up").agg(F.min("id").alias("comp"))
    labels = scratch.cut(at.join(least, "up").select("id", "comp"), f"{name}-labels")
    scratch.drop(f"{name}-at", f"{name}-{len(moves)}", *[f"{name}-move-{i}" for i in range(len(moves))])
    return labels
