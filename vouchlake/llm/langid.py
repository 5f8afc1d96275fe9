"""Language ID by compression with per-language raw-content dictionaries.

A bounded sample of labelled rows (SAMPLE_DOCS for each language, lowest hash
first, at most DICT_BYTES of dictionary) makes one zstandard raw-content
dictionary a language; a text belongs to the language whose dictionary encodes
it smallest. Every BLOCK bytes of a text are encoded afresh and the sizes added
up, so that the saving by a dictionary grows with the text. A lead of under GAP
bytes (short ambiguous texts) or under MARGIN of the size is rejected. Null or
letterless text is `und` and rejected. Ties go to the language first in order. A
language with under 8 bytes of letters in its sample is not learned. Rows that
share an id are judged each by its text. Empty input gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchlake.llm.scratch import own_names, small_batches

SAMPLE_DOCS, DICT_BYTES, LEVEL = 100, 64 << 10, 6
BLOCK, GAP, MARGIN = 32 << 10, 2, 0.01
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> str:
    """The words of a text in lower case; empty where it has no letter (`²` or `Ⅷ` are none)."""
    words = " ".join(_WORDS.findall(text.lower())) if text else ""
    return words if any(map(str.isalpha, words)) else ""


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary contents by language, from (doc_id, text, lang)."""
    labelled = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    near = F.lit(False)
    for lang, n in counts.items():
        near = near | ((F.col("lang") == lang) & (h < 2.0 * SAMPLE_DOCS / n))
    w = Window.partitionBy("lang").orderBy(h, "doc_id")
    rows = labelled.where(near).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SAMPLE_DOCS).select("lang", "text", "rn").collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rn"])):
        out[r["lang"]] = (out.get(r["lang"], b"") + letters(r["text"]).encode() + b" ")[:DICT_BYTES]
    return {k: v for k, v in out.items() if len(v) >= 8}


def identify(spark: SparkSession, docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    small_batches(spark)
    items = sorted(dictionaries.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard as z

        packers = []
        for lang, raw in items:
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append((lang, z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)))
        for pdf in batches:
            got = []
            for t in pdf["text"].tolist():
                clean = letters(t).encode() if isinstance(t, str) else b""
                if not clean or not packers:
                    got.append(("und", 0.0, True))
                    continue
                parts = [clean[i : i + BLOCK] for i in range(0, len(clean), BLOCK)]
                sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in packers)
                best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else sizes[0][0] * 2
                margin = (second - best) / max(1, second)
                score = 1 / sum(math.exp(-min(50.0, n - best)) for n, _ in sizes)
                got.append((sizes[0][1], score, margin < MARGIN or second - best < GAP))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def confident(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with their own columns; of rows
    that share an id, all go if one is rejected."""
    (own,) = own_names(docs, "id")
    bad = identify(spark, docs, learn(docs.where(~held_out(F.col("doc_id"))))).where("rejected").select(F.col("doc_id").alias(own))
    return docs.join(bad, docs["doc_id"] == F.col(own), "left_anti")
