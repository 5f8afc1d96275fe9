"""Streaming twin of the windowed counts: watermark and tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums per event type and tumbling window; works on batch and stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def state_flows(events: DataFrame, key: str = "user_id", state: str = "event_type") -> DataFrame:
    """(key, from_state, to_state, ts) wherever a key's state changes; works on batch and stream.

    A stream must deliver a key's events in time order; one state and time a key is held.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import Window
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = events.select(F.col(key).cast("long").alias("key"), F.col(state).cast("string").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    if not rows.isStreaming:
        w = Window.partitionBy("key").orderBy("ts", "state")
        return rows.withColumn("was", F.lag("state").over(w)).where("was <> state").select("key", F.col("was").alias("from_state"), F.col("state").alias("to_state"), "ts")

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts", "state"], kind="stable")
        was = ([held.get[0]] if held.exists else [None]) + pdf["state"].tolist()[:-1]
        changed = [a is not None and b is not None and a != b for a, b in zip(was, pdf["state"], strict=True)]
        held.update((pdf["state"].iloc[-1],))
        yield pd.DataFrame({"key": k[0], "from_state": was, "to_state": pdf["state"], "ts": pdf["ts"]})[changed]

    return rows.groupBy("key").applyInPandasWithState(step, "key long, from_state string, to_state string, ts timestamp", "state string", "append", GroupStateTimeout.NoTimeout)
