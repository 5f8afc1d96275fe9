"""Token counts by rank-synchronous merging of batched pre-tokens.

Texts are split by the vocabulary's pre-token pattern; the distinct pre-tokens
of a batch that are new to the worker are merged together (bpe.Merger) and the
surviving symbols counted. Null text is empty: 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vouchlake.llm.bpe import Merger
from vouchlake.llm.scratch import small_batches

CACHE = 400_000
#: Fixed value: white space as the vocabulary's pattern means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class Counter:
    def __init__(self, path: str):
        import regex

        self.merger, self.known = Merger(path), {}
        self.find = regex.compile(PATTERN).findall
        names = sorted(self.merger.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.names = names

    def count(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for t in texts:
            n = 0
            if any(s in t for s in self.names):
                parts = self.special.split(t)
                n = len(parts) - 1
                split.append([w for p in parts for w in self.find(p)])
            else:
                split.append(self.find(t))
            extra.append(n)
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for ws in split for w in ws}.difference(self.known))
        if new:
            self.known.update(zip(new, self.merger.merge([w.encode() for w in new])[1].tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, ws)) + n for ws, n in zip(split, extra, strict=True)]


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    small_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(path)
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            n = counter.count(texts)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
