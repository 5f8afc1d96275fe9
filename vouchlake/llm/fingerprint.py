"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk where it falls under 2^32 / block
size; each chunk gives one signature character. The block size is the smallest
of the family 4, 8, 16, ... with at most 64 chunks, and the fingerprint holds
the signatures at that size and at its double, then five characters of a hash
of the whole text. Equal fingerprints are alike (1.0). Others compare by edit
distance at a common block size, where a common run of four characters is asked
for: signatures under four characters, of very short texts, are never alike.
Null text is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchlake.llm.scratch import Scratch, small_batches

_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
MOST, RUN = 64, 4


def rolling(data: bytes) -> np.ndarray:
    b = np.frombuffer(b"\0" * 7 + data, np.uint8).astype(np.uint64)
    two = b[:-1] | (b[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    seven = four[:-4] | (four[4:] << np.uint64(32))
    return (((seven[1:] >> np.uint64(8)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def _signature(h: np.ndarray, block: int) -> str:
    if not len(h):
        return ""
    ends = np.flatnonzero(h < (1 << 32) // block) + 1
    starts = np.concatenate(([0], ends[ends < len(h)]))
    sums = np.add.reduceat(h * (h | np.uint64(1)), starts)
    chars = _CHARS[((sums * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58)).astype(np.int64)]
    if len(chars) > 3:  # runs of one character say little
        same = chars[1:] == chars[:-1]
        keep = np.ones(len(chars), bool)
        keep[3:] = ~(same[2:] & same[1:-1] & same[:-2])
        chars = chars[keep]
    return chars.tobytes().decode()


def fingerprint(text: str) -> str:
    h = rolling(text.encode())
    block = 4
    while np.count_nonzero(h < (1 << 32) // block) >= MOST:
        block *= 2
    whole = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big") >> 2
    check = "".join(chr(_CHARS[whole >> 6 * i & 63]) for i in range(5))
    return f"{block}:{_signature(h, block)}:{_signature(h, 2 * block)}:{check}"


def _alike(a: str, b: str) -> float:
    if not {a[i : i + RUN] for i in range(len(a) - RUN + 1)} & {b[i : i + RUN] for i in range(len(b) - RUN + 1)}:
        return 0.0
    if a == b:
        return 1.0
    # bit-parallel longest common subsequence: edit distance without substitution
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 0 where no block size is common to both."""
    if a == b:
        return 1.0
    (x, x1, x2, _), (y, y1, y2, _) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_alike(x1, y1), _alike(x2, y2))
    if x == 2 * y:
        return _alike(x1, y2)
    return _alike(x2, y1) if y == 2 * x else 0.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = [c.split()[0] for c in ROW.split(", ")]


def _row(a: tuple, b: tuple) -> tuple:
    """The result's row for (doc_id, text, fingerprint), given those of the next document."""
    e = edited(a[1], b[1])
    fe = fingerprint(e)
    return a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), a[2], fe, likeness(a[2], fe), likeness(a[2], b[2])


def compare_with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, its edited text and its neighbour in descending doc_id.

    Texts are sorted by range of doc_id, once. A task compares each of its rows
    with the one after it and hands out its first and last document; these, two
    a task, meet in a second small pass. Rows that share a doc_id are ordered by
    the SHA-256 of the text. A document alone follows itself. Empty input gives
    an empty result; other columns are ignored.
    """
    small_batches(spark)
    scratch = Scratch(spark, "fingerprints")
    text = F.coalesce("text", F.lit(""))
    order = [F.desc("doc_id"), F.col("digest")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None
        columns = [*FIELDS, "end", "part", "text"]

        def end(kind: str, of: tuple) -> tuple:
            return of[0], 0, "", "", "", 0.0, 0.0, kind, part, of[1]

        for pdf in batches:
            out = []
            for doc, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                now = (doc, t, fingerprint(t))
                out.append(end("first", now) if last is None else (*_row(last, now), "", part, ""))
                last = now
            yield pd.DataFrame(out, columns=columns)
        if last is not None:
            yield pd.DataFrame([end("last", last)], columns=columns)

    made = scratch.cut(dealt.mapInPandas(run, f"{ROW}, end string, part int, text string"), "made")
    # which task follows which: one row for each task that had rows
    firsts, lasts = made.where("end = 'first'"), made.where("end = 'last'").select("doc_id", "text", "part")
    w = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(w)).alias("next"))
    pairs = lasts.join(after, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next").select("doc_id", "text", "following")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_row((d, t, fingerprint(t)), (None, f, fingerprint(f))) for d, t, f in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["following"].tolist(), strict=True)]
            yield pd.DataFrame(out, columns=FIELDS)

    return made.where("end = ''").select(*FIELDS).union(pairs.mapInPandas(close, ROW))
