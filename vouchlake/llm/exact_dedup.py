"""Exact dedup against a persistent digest index, DataFrame operations only.

The index is a folder: data of (digest, keep_id, batch) bucketed and sorted by
digest, and a settings table with the generation in use and its bucket count,
so that any later session opens it as it was written. A batch is reduced to
digests once; its winners are found with a partial aggregate, a sort-merge
anti-join removes the texts that the index holds, and the rest is appended.
``compact`` writes the next generation with one sorted file a bucket.

Null text counts as empty. Within a batch the row with the largest id stays; a
text the index holds already keeps its earlier row. ``group_size`` counts the
batch alone. Rows that repeat both id and text are one document and are flagged
alike; rows that share an id but not a text are judged apart; a null id is the least. Empty input gives
an empty result. Other columns are ignored, or kept as they are.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.llm.scratch import Scratch, own_names

ROWS_A_BUCKET = 2_000_000
_SETTINGS = "generation INT, buckets INT"


class DigestIndex:
    """Opens the index at ``path``, or makes one with ``buckets`` buckets; an
    existing index keeps its own count."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        settings = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/settings/_SUCCESS")
        if settings.getFileSystem(spark._jsc.hadoopConfiguration()).exists(settings):
            now = spark.read.schema(_SETTINGS).parquet(f"{self.path}/settings").orderBy(F.desc("generation")).first()
            self._open(now["generation"], now["buckets"])
        else:
            self._open(1, int(buckets))
            self._record()

    def _open(self, generation: int, buckets: int) -> None:
        self.generation, self.buckets = generation, buckets
        self.data = f"{self.path}/data-{generation}"
        self.table = f"digest_index_{hashlib.sha256(self.data.encode()).hexdigest()[:16]}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.data}'"
        )

    def _record(self) -> None:
        self.spark.createDataFrame([(self.generation, self.buckets)], _SETTINGS).write.mode("append").parquet(f"{self.path}/settings")

    def _write(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.data).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame, batch: str) -> None:
        """Append the texts of ``digests`` (id, digest) that the index lacks."""
        winners = digests.groupBy("digest").agg(F.max("id").alias("keep_id"))
        fresh = winners.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh.withColumn("batch", F.lit(batch)))

    def compact(self, buckets: int | None = None) -> None:
        """Write the next generation, with one sorted file a bucket; the last one stays for its readers."""
        rows = self.read()
        self._open(self.generation + 1, int(buckets or self.buckets))
        self._write(rows)
        self._record()


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))


def _flagged(spark: SparkSession, digests: DataFrame, scratch: Scratch, index: DigestIndex | None, buckets: int | None) -> DataFrame:
    if index is None:
        index = DigestIndex(spark, scratch.path("index"), buckets or max(16, digests.count() // ROWS_A_BUCKET))
    index.add(digests, uuid.uuid4().hex)
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    kept = index.read().join(sizes, "digest").select("digest", "keep_id", "group_size")
    return digests.join(kept.hint("merge"), "digest")


def exact_dedup(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, buckets: int | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Copies may be a third of all rows: groups are counted with map-side partial
    sums, and the join back is a plain shuffled one, whose large partitions
    adaptive execution splits. Without an index, one is made for this batch with
    buckets by its size.
    """
    scratch = Scratch(spark, "exact")
    digests = scratch.cut(_digests(docs, id_col, text_col), "digests")
    return _flagged(spark, digests, scratch, index, buckets).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_first_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns; rows that repeat id and text once."""
    scratch = Scratch(spark, "exact")
    digests = scratch.cut(_digests(docs, id_col, text_col), "digests")
    keep, digest, sha = own_names(docs, "keep", "digest", "sha")
    flagged = _flagged(spark, digests, scratch, None, None).where(F.col("id").eqNullSafe(F.col("keep_id")))
    stay = flagged.select(F.col("id").alias(keep), F.col("digest").alias(digest)).distinct()
    text = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    marked = docs.withColumn(sha, text)
    joined = marked.join(stay, marked[id_col].cast("long").eqNullSafe(F.col(keep)) & (F.col(sha) == F.col(digest)), "left_semi")
    if not digests.groupBy("id", "digest").count().where("count > 1").isEmpty():
        joined = joined.dropDuplicates([id_col, sha])
    return joined.drop(sha)
