"""Written tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
again, so that a lost executor costs a re-read and not a recomputation. Where
the setting is absent (tests on a local master) a private folder is made; on
any other master its absence is an error, since a machine-local folder would
be invisible to the other machines.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Spark's setting: shuffle files of a query are deleted when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="vouchlake-")
    return f"file://{_OWN[app]}"


class Scratch:
    """Stages tables of one job and removes them when they are no longer read."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/vouchlake/{job}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def cut(self, df: DataFrame, name: str, codec: str = "snappy", clean: bool = False) -> DataFrame:
        """Write ``df`` below this job's folder and return it as read back; ``clean``: its
        shuffle files go when it is written, not when the driver's garbage is collected."""
        path = self.path(name)
        before = self.spark.conf.get(_CLEAN, None)
        if clean:
            self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        finally:
            if clean:
                self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete staged tables; their DataFrames must not be used again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            target = jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(conf).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches of this session: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with so many underscores before each that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
