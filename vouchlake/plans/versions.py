"""Queries over versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vouchlake.sources.versioned import VersionedTable
from vouchlake.staging import shared_folder


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event, taken in by two batches, the second of them twice."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id key", "ts modified", "event_id", "event_type")
    table = VersionedTable(spark, f"{shared_folder(spark)}/latest-events-{uuid.uuid4().hex[:12]}")
    for batch in (0, 1, 1):
        table.upsert(events.where(f"event_id % 2 = {batch}"), f"batch {batch}")
    return table.read()


QUERIES = {"latest_events": latest_events}
ORACLE_SQL = {
    "latest_events": """
        SELECT user_id AS key, ts AS modified, event_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2 DESC, event_id DESC) = 1""",
}
