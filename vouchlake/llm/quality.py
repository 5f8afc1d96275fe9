"""Quality by co-training: a text-content view and a page-metadata view.

The text view reads words, the letter triples of words and surface ratios of the
text; the metadata view reads source, language and length band. Each view is a
naive Bayes model over hashed features, calibrated by a logistic regression on
labelled rows set aside. Labels are fitted on a bounded sample (SAMPLE documents,
lowest hash first). Over ROUNDS each view labels all other documents; those
it is sure of (SURE) are counted, by distributed sums over the whole table, into
the other view's training counts, together as heavy as the labels at most. The
combined score weighs the calibrated views by their log loss and covers all
documents.

Null text counts as empty, null source or language as a value of its own; of
repeated labels the greatest holds. Without labels of both kinds nothing can be
learned: every score is 0.5 and every document is kept. Rows that share an id are
scored each by its text. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.llm.scratch import Scratch, small_batches

SAMPLE, ROUNDS, SURE, PRIOR = 20_000, 3, 0.95, 4.0
RATIOS, STEPS, WORDS, TRIPLES = 10, 17, 8192, 2048
SOURCES, LANGS, BANDS = 1024, 64, 32
#: Where each group of features begins, and the end, in the two views.
TEXT_AT = (0, RATIOS * STEPS, RATIOS * STEPS + WORDS, RATIOS * STEPS + WORDS + TRIPLES)
META_AT = (0, SOURCES, SOURCES + LANGS, SOURCES + LANGS + BANDS)
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


class Featurer:
    """Sorted ids of the features a text has."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def _word(self, w: str) -> np.ndarray:
        import xxhash

        triples = {f"<{w}>"[i : i + 3] for i in range(min(len(w), 30))}
        return np.array([TEXT_AT[1] + xxhash.xxh32_intdigest(w) % WORDS, *(TEXT_AT[2] + xxhash.xxh32_intdigest(t, 1) % TRIPLES for t in triples)], np.uint16)

    def __call__(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text.lower())
        mine = set(tokens)
        if len(self.known) > 200_000:
            self.known = {}
        for w in mine.difference(self.known):
            self.known[w] = self._word(w)
        steps = np.minimum(STEPS - 1, (np.array(ratios(text, tokens, mine)) * (STEPS - 1)).astype(int))
        return np.unique(np.concatenate([(np.arange(RATIOS) * STEPS + steps).astype(np.uint16), *map(self.known.__getitem__, mine)]))


def ratios(text: str, tokens: list[str], mine: set[str]) -> list[float]:
    b = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256).astype(float)
    n, lines = max(1.0, b.sum()), text.split("\n")
    sym = b[[ord(c) for c in "#$%&*+<=>@^_`|~{}[]\\"]].sum()
    mark = b[[ord(c) for c in ".,;:!?'\"()-/"]].sum()
    return [b[65:91].sum() / n, b[48:58].sum() / n, min(1.0, 4 * sym / n), min(1.0, 4 * mark / n), (b[32] + b[9:14].sum()) / n, b[128:].sum() / n,
            min(20.0, n / max(1, len(tokens))) / 20, len(mine) / max(1, len(tokens)), 1 - len(set(lines)) / len(lines), sum(map(eq, tokens, tokens[1:])) / max(1, len(tokens))]


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A naive Bayes model by groups of features, and its calibration."""

    at: tuple[int, ...]
    odds: np.ndarray
    mix: np.ndarray

    def groups(self, rows: list[np.ndarray]) -> np.ndarray:
        """For each row and group the sum of log odds over the root of their number."""
        size = np.array([len(r) for r in rows], np.int64)
        ids = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
        cell = np.repeat(np.arange(len(rows)), size) * (len(self.at) - 1) + np.searchsorted(self.at, ids, side="right") - 1
        total, n = (np.bincount(cell, v, minlength=len(rows) * (len(self.at) - 1)) for v in (self.odds[ids], None))
        return (total / np.sqrt(np.maximum(1, n))).reshape(len(rows), -1)

    def logit(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.clip(self.groups(rows) @ self.mix[:-1] + self.mix[-1], -30, 30)


def learned(at: tuple[int, ...], counts: np.ndarray, n: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> View:
    """A view from counts of features by class, calibrated on rows set aside."""
    pooled = (counts.sum(axis=0) + 0.5) / (n.sum() + 1.0)  # what neither class has seen says nothing
    share = (counts + PRIOR * pooled) / (n[:, None] + PRIOR)
    view = View(at, np.log(share[1] / share[0]), np.zeros(len(at)))
    view.mix = _fit(view.groups(rows), y)
    return view


def counted(at: tuple[int, ...], rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with each feature, and rows, by class."""
    pick = lambda c: np.concatenate([np.empty(0, np.int64), *(r for r, v in zip(rows, y, strict=True) if v == c)]).astype(np.int64)
    return np.stack([np.bincount(pick(c), minlength=at[-1]) for c in (0, 1)]).astype(float), np.array([(y == 0).sum(), (y == 1).sum()], float)


def _ids(raw: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16) for b in raw]


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, text_score, meta_score, keep for every document."""
    small_batches(spark)
    scratch = Scratch(spark, "quality")
    text = F.coalesce("text", F.lit(""))
    hashed = lambda c, seed, n: F.pmod(F.xxhash64(F.coalesce(c, F.lit("\0")), F.lit(seed)), F.lit(n))
    band = F.least(F.floor(2 * F.log2(F.length(text) + 1)), F.lit(BANDS - 1)).cast("long")
    meta = F.array(hashed("source", 0, SOURCES), hashed("lang", 1, LANGS) + META_AT[1], band + META_AT[2])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), meta.alias("meta"), text.alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature = Featurer()
        for pdf in batches:
            packed = [np.array(m, np.uint16).tobytes() for m in pdf["meta"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "meta": packed, "x": [feature(t).tobytes() for t in pdf["text"]]})

    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    feats = scratch.cut(rows.mapInPandas(features, "doc_id long, meta binary, x binary"), "features")
    # about SAMPLE labels by hash; few enough for every task
    share = min(1.0, 1.2 * SAMPLE / max(1, known.count()))
    h = F.xxhash64("doc_id", F.lit(5))
    sampled = scratch.cut(known.where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20)).orderBy(h, "doc_id").limit(SAMPLE), "labels")
    train = feats.join(F.broadcast(sampled), "doc_id").orderBy(h, "doc_id", "x").toPandas()
    y = (train["y"].to_numpy(float) > 0.5).astype(int)
    if len(set(y.tolist())) < 2:
        half = F.lit(0.5)
        return feats.select("doc_id", half.alias("quality"), half.alias("text_score"), half.alias("meta_score"), F.lit(True).alias("keep"))

    aside = np.arange(len(y)) % 4 == 0 if len(y) >= 50 else np.ones(len(y), bool)
    use = ~aside if len(y) >= 50 else aside
    if len(set(y[use].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        aside = use = np.ones(len(y), bool)
    sides = {"x": TEXT_AT, "meta": META_AT}
    held = {c: _ids(train[c]) for c in sides}
    pick = lambda c, mask: [r for r, m in zip(held[c], mask, strict=True) if m]
    base = {c: counted(at, pick(c, use), y[use]) for c, at in sides.items()}
    views = {c: learned(at, *base[c], pick(c, aside), y[aside]) for c, at in sides.items()}

    def sure(views: dict[str, View]):
        """Counts of the features, by view and class, of what the other view is sure of."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {c: np.zeros((2, v.at[-1] + 1)) for c, v in views.items()}
            for pdf in batches:
                for c, teacher in (("x", "meta"), ("meta", "x")):
                    p = 1 / (1 + np.exp(-views[teacher].logit(_ids(pdf[teacher]))))
                    at = np.flatnonzero((p > SURE) | (p < 1 - SURE))
                    if len(at):
                        got, n = counted(views[c].at, _ids(pdf[c].iloc[at]), (p[at] > 0.5).astype(int))
                        sums[c] += np.hstack([got, n[:, None]])
            out = [(c, k, i, s[k, i]) for c, s in sums.items() for k in (0, 1) for i in np.flatnonzero(s[k]).tolist()]
            yield pd.DataFrame(out, columns=["view", "label", "feature", "n"])

        return run

    free = feats.join(F.broadcast(sampled.select("doc_id")), "doc_id", "left_anti").select("meta", "x")
    for _ in range(ROUNDS):
        sums = free.mapInPandas(sure(views), "view string, label int, feature int, n double").groupBy("view", "label", "feature").agg(F.sum("n").alias("n")).toPandas()
        for c, at in sides.items():
            mine, more = sums[sums["view"] == c], np.zeros((2, at[-1] + 1))
            more[mine["label"].to_numpy(int), mine["feature"].to_numpy(int)] = mine["n"]
            weight = min(1.0, base[c][1].sum() / max(1.0, more[:, -1].sum()))
            views[c] = learned(at, base[c][0] + weight * more[:, :-1], base[c][1] + weight * more[:, -1], pick(c, aside), y[aside])
    loss = {}
    for c, v in views.items():
        p = 1 / (1 + np.exp(-v.logit(pick(c, aside))))
        loss[c] = -np.mean(np.log(np.clip(np.where(y[aside] == 1, p, 1 - p), 1e-9, 1)))
    weigh = {c: np.exp(-8 * n) for c, n in loss.items()}

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = {c: v.logit(_ids(pdf[c])) for c, v in views.items()}
            both = (weigh["x"] * z["x"] + weigh["meta"] * z["meta"]) / sum(weigh.values())
            got = {"quality": both, "text_score": z["x"], "meta_score": z["meta"]}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{k: 1 / (1 + np.exp(-v)) for k, v in got.items()}, "keep": both >= 0})

    return feats.select("doc_id", "meta", "x").mapInPandas(final, "doc_id long, quality double, text_score double, meta_score double, keep boolean")
