"""Tables in versions, taken up by one small file, and datasets made in stages.

A version is a folder of Parquet files of its own; it counts once its entry stands in the
log, which is renamed into place whole. A reader sees the version of the last entry, so
that a job that dies while writing leaves the table as it was. Entries name what made
them (a stage, a batch of a stream): what is in the log is not done again. Files go
through Hadoop's file systems, so that any store of Spark's will do. Writers take turns;
two at once are refused by the log, and the later one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):  # noqa: ANN202
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def log(self) -> list[dict]:
        """All entries, the oldest first: version, folder, made_by."""
        files, folder = self._at("log")
        if not files.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return [json.loads(self.spark.read.text(f"{self.path}/log/{n}").first()[0]) for n in names]

    def done(self, made_by: str) -> bool:
        return any(e["made_by"] == made_by for e in self.log())

    def read(self) -> DataFrame | None:
        """The table as of the last entry; None before the first."""
        log = self.log()
        return self.spark.read.parquet(f"{self.path}/{log[-1]['folder']}") if log else None

    def commit(self, df: DataFrame, made_by: str) -> DataFrame:
        """Write `df` as the next version; it may read the current one."""
        version = len(self.log())
        folder = f"data/{version:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{folder}")
        entry = json.dumps({"version": version, "folder": folder, "made_by": made_by})
        files, whole = self._at(f"log/{version:08d}.json")
        _, draft = self._at(f"log/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(entry.encode()))
        out.close()
        if files.exists(whole) or not files.rename(draft, whole):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} was written by another job")
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def upsert(self, rows: DataFrame, made_by: str, key: str = "key", order: str = "modified") -> None:
        """Take in the latest row of each key, once for each `made_by`; rows without a key are passed over."""
        if self.done(made_by):
            return
        now = self.read()
        every = rows.where(F.col(key).isNotNull()).withColumn("_new", F.lit(1))
        every = every if now is None else every.unionByName(now.withColumn("_new", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc("_new"), *[F.desc(c) for c in rows.columns]))
        self.commit(every.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new"), made_by)

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders of all but the last versions, and those that no entry names."""
        files, folder = self._at("data")
        kept = {e["folder"].split("/")[1] for e in self.log()[-keep:]}
        for s in files.listStatus(folder) if files.exists(folder) else []:
            if s.getPath().getName() not in kept:
                files.delete(s.getPath(), True)


class StagedDataset:
    """A table made by named stages, each a function from the table so far to the next."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path)

    def run(self, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]]) -> DataFrame:
        """Do the stages that the log does not hold, in order, and return the table."""
        for name, stage in stages:
            if not self.table.done(name):
                self.table.commit(stage(self.table.read()), name)
        return self.table.read()

    def retry(self, name: str, stage: Callable[[DataFrame], DataFrame], ok: str) -> DataFrame:
        """Do a stage again for the rows whose flag `ok` is false or null; the others stay as they are."""
        now = self.table.read()
        failed = ~F.coalesce(F.col(ok), F.lit(False))
        if now.where(failed).isEmpty():
            return now
        again = stage(now.where(failed)).select(*now.columns)
        attempt = sum(e["made_by"].startswith(f"{name}, again") for e in self.table.log()) + 1
        return self.table.commit(now.where(~failed).unionByName(again), f"{name}, again {attempt}")


def documents_to_do(docs: DataFrame, done: str, failed: str, fresh: bool = True) -> DataFrame:
    """The documents a stage has to do: those neither done nor failed, or else those that failed."""
    was = lambda c: F.coalesce(F.col(c), F.lit(False))
    return docs.where(~was(done) & (~was(failed) if fresh else was(failed)))
