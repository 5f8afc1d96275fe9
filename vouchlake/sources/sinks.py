"""Sinks: JSON, CSV, label tasks, DOT graphs, vector tables, schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def to_json(df: DataFrame, path: str, compress: bool = False, kind: str | None = None) -> None:
    """One JSON object a line, gzipped at will; `kind` adds a `_type` field."""
    out = df.withColumn("_type", F.lit(kind)) if kind else df
    out.write.mode("overwrite").option("compression", "gzip" if compress else "none").option("ignoreNullFields", False).json(path)


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by `;` in sorted order."""
    flat = [F.array_join(F.array_sort(c), ";").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def label_tasks(df: DataFrame, key: str, text: str, choices: str) -> DataFrame:
    """One labelling task a row as JSON: the text and its candidate labels."""
    return df.select(F.to_json(F.struct(F.struct(F.col(key).alias("id"), F.col(text).alias("text"), F.array_sort(choices).alias("choices")).alias("data"))).alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """A graph's DOT text, one edge a row; wrap in `digraph { }` when joining."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("value"))


def vector_table(df: DataFrame, path: str, buckets: int = 16) -> None:
    """Vectors as Parquet, spread evenly by id."""
    df.repartition(buckets, "vec_id").write.mode("overwrite").parquet(path)


def check_schema(df: DataFrame, want: StructType) -> DataFrame:
    """`df` in the wanted columns and order; ValueError for a missing or differing one."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(sorted(wrong))}")
    return df.select(*[f.name for f in want])
