"""Mixing sources to target weights by hash-random order and prefix sums.

Every document gets a hash-random key. A source's documents are cut into ranges
of that key, ranges are summed, and running sums inside and over the ranges
give each document its place; the budget of a source cuts that order exactly,
after as many whole epochs as fit. No range holds much over RANGE_ROWS rows or
a RANGES-th of all. Null text has size 0; null source is a source of its own,
last. Rows that share an id are told apart by their text, and rows that repeat
both follow each other. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchlake.llm.scratch import Scratch, own_names

RANGE_ROWS, RANGES = 20_000, 64


def size_of(text: F.Column) -> F.Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], cap: float = 3.0) -> dict[str | None, float]:
    """Shares by weight 1, 2, 3, 1, ...; the excess over cap * size is shared again."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: i % 3 + 1 for i, (s, _) in enumerate(order)}
    size, total, out = dict(order), float(sum(n for _, n in order)), {}
    left, open_ = total, {s for s, _ in order}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > cap * size[s]]
        if not over:
            out.update({s: weight[s] * unit for s in open_})
            break
        for s in over:
            out[s] = cap * size[s]
            left -= out[s]
            open_.discard(s)
    return out


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    scratch = Scratch(spark, "mix")
    text = F.col(text_col)
    # rows that share an id are told apart by their text
    key = F.xxhash64(F.col(id_col), text, F.lit(seed))
    rows = scratch.cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size_of(text).alias("size"), key.alias("key")), "rows")
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    everything = sum(r["n"] for r in stats)
    goal = targets([(r["source"], r["source_size"]) for r in stats])
    table = spark.createDataFrame(
        [(r["source"], int(r["source_size"]), float(goal[r["source"]]), int(round(goal[r["source"]])), max(1, r["n"] // RANGE_ROWS, RANGES * r["n"] // everything)) for r in stats],
        "source2 string, source_size long, target double, budget long, ranges long",
    )
    pos = (F.shiftrightunsigned("key", 33)).cast("long")
    cut = rows.join(table, F.col("source").eqNullSafe(F.col("source2"))).withColumn("range", F.floor(pos * F.col("ranges") / F.lit(float(1 << 31))))
    sums = cut.groupBy("source", "range").agg(F.sum("size").alias("s"))
    before = sums.select(F.col("source").alias("source3"), F.col("range").alias("range3"), (F.sum("s").over(Window.partitionBy("source").orderBy("range")) - F.col("s")).alias("before"))
    w = Window.partitionBy("source", "range").orderBy(pos, "key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0))).join(before, F.col("source").eqNullSafe(F.col("source3")) & (F.col("range") == F.col("range3")))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents the mix takes, once for each epoch begun; a document at a
    source's cut goes in whole."""
    own, times, epoch = own_names(docs, "id", "times", "epoch")
    epochs = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    taken = mix(spark, docs).groupBy(F.col("doc_id").alias(own)).agg(F.max(epochs).alias(times))
    joined = docs.join(taken, docs["doc_id"] == F.col(own)).where(F.col(times) > 0)
    return joined.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
