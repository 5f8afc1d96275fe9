"""Text and vector operators as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries and rows held by one task of a vector search.
QUERY_BLOCK, ROW_BLOCK = 128, 16_384


def garbage_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look unreadable: few lines, little text, short lines, few letters."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 0")
    n, lines = F.length("text"), F.size(F.split("text", "\n", -1))
    alpha = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / n
    return d.select("doc_id", (lines < 30).alias("few_lines"), (n < 1000).alias("small"), (n / lines < 10).alias("short_lines"), (alpha < 0.5).alias("few_letters"))


def chunk_text_overlap(spark: SparkSession, sf_dir: str, size: int = 512, stride: int = 384) -> DataFrame:
    """Word chunks of `size`, begun every `stride` words."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", " ").alias("w"))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(stride)))
    return d.select("doc_id", "w", at.alias("start")).select("doc_id", F.expr(f"cast(start div {stride} as bigint)").alias("chunk"), F.md5(F.array_join(F.expr(f"slice(w, start + 1, {size})"), " ")).alias("chunk_md5"))


def vector_knn_grouped(spark: SparkSession, sf_dir: str, k: int = 200) -> DataFrame:
    """Score per label over the k chunks nearest to vector 0: 0.7 min + 0.3 mean of squared distance."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))
    q = F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("q")))  # one row
    dist = F.expr("aggregate(zip_with(v, q, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)")
    near = e.crossJoin(q).select("vec_id", "label", dist.alias("d")).orderBy("d", "vec_id").limit(k)
    return near.groupBy("label").agg(F.count("*").alias("n"), F.round(0.7 * F.min("d") + 0.3 * F.avg("d"), 5).alias("score"))


def garbage(docs: DataFrame) -> DataFrame:
    """The five tests of unreadable text and their verdict, for every document; null is empty, and empty is garbage.

    Lines end where str.splitlines() ends them; letters are those of any script.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.split(text, "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]", -1)
    lines = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    d = docs.select("doc_id", F.length(text).alias("n"), F.length(F.regexp_replace(text, "\\P{L}+", "")).alias("alpha"), lines.alias("lines"))
    second = F.transform("lines", lambda s: F.regexp_replace(s, "(?s).(.?)", "$1"))
    varied = F.size(F.filter(second, lambda s: F.replace(s, F.substring(s, 1, 1), F.lit("")) != ""))
    content = F.aggregate("lines", F.lit(0).cast("long"), lambda a, s: a + F.length(s))
    tests = {"few_lines": F.size("lines") < 30, "small": F.col("n") < 1000, "short_lines": (content < 10 * F.size("lines")) | (content == 0), "few_every_second": varied < 15, "few_letters": (F.col("alpha") < 0.5 * F.col("n")) | (F.col("n") == 0)}
    flagged = d.select("doc_id", *[t.alias(name) for name, t in tests.items()])
    return flagged.withColumn("garbage", F.greatest(*tests))


def vector_search(vectors: DataFrame, every: int = 100, k: int = 2000) -> DataFrame:
    """query_id, label, n, score over the k rows nearest to each row whose id is divisible by `every`.

    Blocks of queries meet blocks of rows, each pair in a task of bounded size, and
    leave at most k rows a query; of these the nearest k are taken.
    """
    e = vectors.select("vec_id", "label", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))
    asked = F.col("vec_id") % every == 0
    counts = e.agg(F.count("*").alias("n"), F.count(F.when(asked, 1)).alias("q")).first()
    tall, wide = max(1, -(-counts["q"] // QUERY_BLOCK)), max(1, -(-counts["n"] // ROW_BLOCK))
    rows = e.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(wide).cast("long"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tall - 1).cast("long"))))
    queries = e.where(asked).select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(tall).cast("long")).alias("block"), F.col("vec_id").alias("query_id"), "v").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))))

    def nearest(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("vec_id", kind="stable")
            ids, labels, dims = r["vec_id"].to_numpy(), r["label"].to_numpy(), np.ascontiguousarray(np.stack(r["v"].to_list()).T)
            for query, at in zip(q["query_id"], q["v"], strict=True):
                d = np.zeros(len(ids))
                for x, y in zip(dims, at, strict=True):
                    d += (x - y) ** 2
                best = np.argsort(d, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": query, "label": labels[best], "vec_id": ids[best], "d": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "label": [], "vec_id": [], "d": []})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    met = queries.groupBy("block", "slice").cogroup(rows.groupBy("block", "slice")).applyInPandas(nearest, f"query_id {kinds['vec_id']}, label {kinds['label']}, vec_id {kinds['vec_id']}, d double")
    near = met.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rn") <= k)
    return near.groupBy("query_id", "label").agg(F.count("*").alias("n"), F.round(0.7 * F.min("d") + 0.3 * F.avg("d"), 5).alias("score"))


def garbage_text_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbage(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def vector_search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (garbage_text_flags, chunk_text_overlap, vector_knn_grouped, garbage_text_detector, vector_search_grouped)}
ORACLE_SQL = {
    "garbage_text_flags": """
        SELECT doc_id, n_lines < 30 AS few_lines, n < 1000 AS small, n / n_lines < 10 AS short_lines, alpha / n < 0.5 AS few_letters FROM (
          SELECT doc_id, length(text) AS n, len(string_split(text, chr(10))) AS n_lines, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS alpha FROM documents WHERE length(text) > 0)""",
    "chunk_text_overlap": """
        SELECT doc_id, cast(s // 384 AS bigint) AS chunk, md5(array_to_string(w[s + 1:s + 512], ' ')) AS chunk_md5
        FROM (SELECT doc_id, w, unnest(range(0, len(w), 384)) AS s FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))""",
    "vector_knn_grouped": """
        SELECT label, count(*) AS n, round(0.7 * min(d) + 0.3 * avg(d), 5) AS score FROM (
          SELECT e.label, e.vec_id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::double - q.embedding[i]::double) ** 2)) AS d
          FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, vec_id LIMIT 200) GROUP BY 1""",
    "garbage_text_detector": r"""
        SELECT *, few_lines OR small OR short_lines OR few_every_second OR few_letters AS garbage FROM (
          SELECT doc_id, len(l) < 30 AS few_lines, n < 1000 AS small, coalesce(list_sum(list_transform(l, lambda s: length(s))) / len(l), 0) < 10 AS short_lines,
                 len(list_filter(l, lambda s: len(list_distinct(list_filter(regexp_extract_all(s, '(?s).'), lambda c, i: i % 2 = 0))) > 1)) < 15 AS few_every_second,
                 n = 0 OR alpha / n < 0.5 AS few_letters FROM (
            SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^\pL]', '', 'g')) AS alpha, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l FROM (
              SELECT doc_id, t, regexp_split_to_array(t, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))""",
    "vector_search_grouped": """
        SELECT query_id, label, count(*) AS n, round(0.7 * min(d) + 0.3 * avg(d), 5) AS score FROM (
          SELECT query_id, label, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rn FROM (
            SELECT q.vec_id AS query_id, e.vec_id, e.label, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::double - q.embedding[i]::double) ** 2)) AS d
            FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rn <= 2000 GROUP BY 1, 2""",
}
