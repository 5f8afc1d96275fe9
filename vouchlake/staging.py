"""Cutting lineage with reliable checkpoints, for loops over DataFrames.

The folder is the session's spark.checkpoint.dir; where that is unset, as in
tests on a local master, a folder of our own is set once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="vouchlake-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` as written to the checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as written to the checkpoint folder as Parquet and read back: for tables read
    several times, each time by a few columns, by tasks of the scan's size."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
