"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Texts hash into SLOTS virtual slots, so equal texts share one. Bytes are summed
per slot, and slots go largest first to the lightest shard. Of slots that weigh
over an eighth of a shard, texts over a sixteenth of a shard are slots of their
own; only a text that no shard can hold is cut, by document hash. The map is a
written table with a version: ``shard`` on a folder that holds one edits it by
moving few slots and writes the next version beside it.

Null text has size 1. Ties go to the lower slot and the lower shard. Rows that
share an id are told apart by their text. Empty input gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchlake.llm.scratch import Scratch

SLOTS = 4096
CHUNK_ROWS = 20_000
Unit = tuple[int, int, int]  # virtual slot, hash of a heavy text or 0, chunk
_MAP = "virtual_slot int, heavy long, chunk int, shard int"


def assign(sizes: dict[Unit, int], shards: int) -> dict[Unit, int]:
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (total + size, shard))
    return out


def rebalance(current: dict[Unit, int], sizes: dict[Unit, int], shards: int, slack: float = 0.02) -> dict[Unit, int]:
    """Edit a map: units without bytes or shard leave it, new slots go to the lightest shard, then slots move from the
    heaviest to the lightest shard while that helps."""
    out, load, fair = {u: s for u, s in current.items() if u in sizes and s < shards}, [0] * shards, sum(sizes.values()) / max(1, shards)
    for unit, shard in out.items():
        load[shard] += sizes[unit]
    for unit in sorted(set(sizes) - set(out), key=lambda u: (-sizes[u], u)):
        out[unit] = min(range(shards), key=lambda s: (load[s], s))
        load[out[unit]] += sizes[unit]
    for _ in range(len(out)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = (load[high] - load[low]) / 2
        movable = [u for u in out if out[u] == high and 0 < sizes.get(u, 0) <= gap]
        if load[high] <= fair * (1 + slack) or not movable:
            break
        best = max(movable, key=lambda u: (sizes[u], u))
        out[best] = low
        load[high] -= sizes[best]
        load[low] += sizes[best]
    return out


class SlotMap:
    """The versions of a map below ``path``, one folder each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(_MAP).parquet(f"{self.path}/v{version}")

    def units(self, version: int) -> dict[Unit, int]:
        return {(r["virtual_slot"], r["heavy"], r["chunk"]): r["shard"] for r in self.read(version).collect()}

    def write(self, version: int, units: dict[Unit, int]) -> None:
        rows = [(*u, s) for u, s in sorted(units.items())]
        self.spark.createDataFrame(rows, _MAP).coalesce(1).write.parquet(f"{self.path}/v{version}")


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    What the driver gathers is bounded by `slots` and `shards`: a row a slot, at
    most 16 heavy texts and 48 chunks a shard, and the map.
    """
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    slot = F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")
    rows = scratch.cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            slot.alias("virtual_slot"), F.xxhash64(text, F.lit(17)).alias("text_hash"),
        ),
        "rows",
    )
    per = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    share, n = sum(r["bytes"] for r in per) / shards, sum(r["n"] for r in per)
    sizes: dict[Unit, int] = {(r["virtual_slot"], 0, 0): r["bytes"] for r in per}
    hot = [r["virtual_slot"] for r in per if r["bytes"] > share / 8]
    texts = rows.where(F.col("virtual_slot").isin(hot)).groupBy("virtual_slot", "text_hash").agg(F.sum("size").alias("bytes"))
    store = SlotMap(spark, map_path or scratch.path("map"))
    version = max(store.versions(), default=0)
    old = store.units(version) if version else {}
    cut_before = Counter((v, t) for v, t, _ in old)  # a text that is cut keeps its chunks
    heavy = []
    for r in texts.where(F.col("bytes") > share / 16).collect() if hot else []:
        before = cut_before[r["virtual_slot"], r["text_hash"]]
        chunks = before if before > 1 else math.ceil(r["bytes"] / (share / 32))
        heavy.append((r["virtual_slot"], r["text_hash"], chunks if r["bytes"] > share else 1))
        sizes[r["virtual_slot"], 0, 0] -= r["bytes"]
        sizes[r["virtual_slot"], r["text_hash"], 0] = r["bytes"]
    apart = spark.createDataFrame(heavy, "virtual_slot int, text_hash long, chunks int")
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk")
    if any(chunks > 1 for *_, chunks in heavy):
        cut = rows.join(F.broadcast(apart.where("chunks > 1")), ["virtual_slot", "text_hash"]).groupBy("virtual_slot", "text_hash", chunk)
        sizes |= {(r["virtual_slot"], r["text_hash"], r["chunk"]): r["bytes"] for r in cut.agg(F.sum("size").alias("bytes")).collect()}
    where = rebalance(old, sizes, shards) if version else assign(sizes, shards)
    version += 1
    store.write(version, where)

    unit = rows.join(F.broadcast(apart), ["virtual_slot", "text_hash"], "left")
    unit = unit.withColumn("heavy", F.when(F.col("chunks").isNull(), 0).otherwise(F.col("text_hash")))
    unit = unit.withColumn("chunk", F.coalesce(chunk, F.lit(0)))
    parts = max(1, n // (shards * CHUNK_ROWS))
    placed = unit.join(F.broadcast(store.read(version)), ["virtual_slot", "heavy", "chunk"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(1)), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    w = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return placed.withColumn("rn", F.row_number().over(w)).join(base, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rn") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )
