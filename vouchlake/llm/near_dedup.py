"""MinHash near-dedup with ProbMinHash signatures, banding and verification.

Five-word shingles weigh 1 to 1 + SPREAD, more the more letters they have: the
same in every document, however often it repeats them. Each shingle sends points
of a Poisson process at a rate of its weight; a register keeps the shingle whose
point arrives there first, and a shingle stops once its next point comes after
every register's arrival. Equal registers estimate the probability Jaccard of
the weighted shingles. Where the sets' Jaccard is LEAST it is at least 0.76, so
that some band of four registers meets but for 1 in 700 such pairs, and ESTIMATE
lies four deviations below. The decision is the exact Jaccard of the shingle
sets (LEAST or more).

Documents of a band's bucket that are alike by estimate form candidate groups,
and each group is verified as a whole, its texts sent once. A group beyond one
block (BLOCK documents or SHINGLES shingles) is verified in random blocks; then
a few leaders of each class found so far meet in blocks of their own; what may
still be missed is made up exactly: wherever a band's bucket spans several
classes, the documents outside its largest class meet all others of the bucket,
cell by cell, each pair in the first band it shares.

Null text is empty. Texts under five words are one shingle; texts without a word
match exact copies only. Rows that share an id are one document, with the text
of the greatest MD5. Other columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.llm.components import components
from vouchlake.llm.scratch import Scratch, own_names, small_batches

WORDS, LEAST, REGISTERS, ROWS, ESTIMATE = 5, 0.8, 64, 4, 0.55
BLOCK, SHINGLES, LEADERS, SPREAD = 512, 10_000_000, 8, 0.25
BANDS = REGISTERS // ROWS
_WORD = re.compile(r"\w+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


class Shingler:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, sorted, and their weights, the same in every document."""
        import xxhash

        words = _WORD.findall(text.lower())
        if not words:
            return np.empty(0, np.uint64), np.empty(0)
        if len(self.known) > 300_000:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        letters = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        k = min(WORDS, len(h))
        s = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            s = _mix(s + h[i : len(h) - k + 1 + i] + np.uint64(i + 1))
        s, first = np.unique(s, return_index=True)
        return s, 1 + SPREAD * np.minimum(1.0, (letters[k:] - letters[:-k])[first] / 50)


def signature(shingles: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: 16 bits of the first shingle to arrive at each register."""
    best, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    at, alive, state, turn = np.zeros(len(shingles)), np.arange(len(shingles)), shingles.copy(), 0
    while len(alive):
        turn += 1
        state = _mix(state + np.uint64(turn * int(_A) % (1 << 64)))
        u = ((state >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)
        at = at - np.log(u) / weight[alive]
        reg = (_mix(state ^ _B) >> np.uint64(40)).astype(np.int64) % m
        early = at < best.max()
        alive, state, at, reg = alive[early], state[early], at[early], reg[early]
        order = np.argsort(-at, kind="stable")  # the earliest is written last
        r, t, s = reg[order], at[order], shingles[alive[order]]
        ok = t < best[r]
        best[r[ok]], owner[r[ok]] = t[ok], s[ok]
        late = at < best.max()
        alive, state, at = alive[late], state[late], at[late]
    return (_mix(owner) >> np.uint64(48)).astype("<u2")


def packed(sig: np.ndarray) -> bytes:
    """The registers' low bytes, then their high bytes: the first half alone gives estimates."""
    return np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 2).T).tobytes()


def _by_run(key: str, work: Callable[[dict[str, np.ndarray]], list[tuple[int, int]]]) -> Callable:
    """Run `work` on each run of equal keys of a sorted partition; yields pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            now = {c: pdf[c].to_numpy() for c in pdf.columns}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            k, out = now[key], []
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    out += work({c: v[a:b] for c, v in now.items()})
            held = {c: v[cuts[-1] :] for c, v in now.items()}
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if held is not None and len(held[key]) > 1:
            yield pd.DataFrame(work(held), columns=["a", "b"], dtype="int64")

    return run


def _spanning(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """The first id of each component of a link matrix with each other member."""
    left, out = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if left[i]:
            left[i] = False
            fresh = np.flatnonzero(linked[i] & left)
            while len(fresh):
                left[fresh] = False
                out += [(int(ids[i]), m) for m in ids[fresh].tolist()]
                fresh = np.flatnonzero(linked[fresh].any(axis=0) & left)
    return out


def _registers(sigs: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)


def _alike(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Members of a bucket's block that are alike by estimate, as stars."""
    sig = _registers(group["sig"])
    return _spanning(group["id"], np.stack([(sig == s).mean(axis=1) >= ESTIMATE for s in sig]))


def links(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of shingle sets have a Jaccard of LEAST or more, counted exactly."""
    n, size = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    col = np.cumsum(np.concatenate(([True], flat[1:] != flat[:-1]))[: len(flat)]) - 1
    shared = np.bincount(col) > 1
    keep = shared[col]
    owner, col, both = owner[keep], (np.cumsum(shared) - 1)[col[keep]], np.zeros((n, n))
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(col, (lo, lo + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[owner[a:b], col[a:b] - lo] = 1
        both += m @ m.T
    return (both > 0) & (both >= LEAST * (size[:, None] + size[None, :] - both) - 1e-9)


def _verified(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    shingle = Shingler()
    return _spanning(group["id"], links([shingle(t)[0] for t in group["text"]]))


def _promising(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """(id, block) of the documents of a cell that meet one of another class,
    alike by estimate, in the first band that the two share."""
    block, band, sig = int(group["block"][0]), int(group["band"][0]), _registers(group["sig"])
    ids, classes, need = group["id"], group["comp"], np.zeros(len(sig), bool)
    for i in np.flatnonzero(group["minor"].astype(bool)):
        met = np.flatnonzero(classes != classes[i])
        same = (sig[met, :REGISTERS] == sig[i, :REGISTERS]) & (sig[met, REGISTERS:] == sig[i, REGISTERS:])
        first = same.reshape(len(met), BANDS, ROWS).all(axis=2).argmax(axis=1)
        met = met[(same.mean(axis=1) >= ESTIMATE) & (first == band)]
        if len(met):
            need[met], need[i] = True, True
    return [(i, block) for i in np.unique(ids[need]).tolist()]


def _missed(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Links between documents of different classes."""
    shingle, classes = Shingler(), group["comp"]
    linked = links([shingle(t)[0] for t in group["text"]]) & (classes[:, None] != classes[None, :])
    return _spanning(group["id"], linked)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), kept, for every document."""
    small_batches(spark)
    scratch = Scratch(spark, "near")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.md5(text).alias("digest"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for pdf in batches:
            sets = [shingle(t) for t in pdf["text"]]
            sig = [packed(signature(*x)) if len(x[0]) else None for x in sets]
            yield pd.DataFrame({"id": pdf["id"], "digest": pdf["digest"], "sig": sig, "n": [len(s) for s, _ in sets]})

    signed = scratch.cut(texts.mapInPandas(sign, "id long, digest string, sig binary, n long"), "signed")
    one = signed
    repeated = not signed.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:
        one = scratch.cut(signed.groupBy("id").agg(F.max(F.struct("digest", "sig", "n")).alias("x")).select("id", "x.*"), "one")
        texts = texts.join(one.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    reps = scratch.cut(one.groupBy("digest").agg(F.min("id").alias("rep"), F.min("sig").alias("sig"), F.min("n").alias("n")), "reps")
    sigs = reps.where("sig is not null").select(F.col("rep").alias("id"), "sig", "n")
    load = (1 / F.lit(float(BLOCK)) + F.col("n") / F.lit(float(SHINGLES))).alias("load")

    # buckets of each band, and who is alike there by estimate
    plane = lambda b, at: F.substring("sig", at + b * ROWS + 1, ROWS)
    keys = F.array(*[F.xxhash64(F.lit(b), plane(b, 0), plane(b, REGISTERS)) for b in range(BANDS)])
    banded = sigs.select("id", load, F.posexplode(keys).alias("band", "key"))
    full = scratch.cut(banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("load").alias("load")).where("n > 1").drop("n"), "buckets")
    member = scratch.cut(banded.drop("load").join(full, "key"), "members")
    halves = F.when(F.col("load") > 1, F.pow(F.lit(2.0), F.ceil(F.log2("load")))).otherwise(F.lit(1.0)).cast("long")
    blocks = member.select("id", F.xxhash64("key", F.pmod(F.xxhash64("id"), halves)).alias("block"))
    lite = sigs.select("id", F.substring("sig", 1, REGISTERS).alias("sig"))
    alike = blocks.join(lite, "id").repartition("block").sortWithinPartitions("block", "id").mapInPandas(_by_run("block", _alike), "a long, b long")
    groups = components(alike, scratch, "groups").join(sigs.select("id", load), "id")
    parts = groups.groupBy("comp").agg(F.ceil(F.sum("load")).alias("parts"))
    groups = scratch.cut(groups.join(parts, "comp").select("id", "comp", "parts"), "grouped")
    # the texts of all these, and of buckets beyond a block, leave the corpus once
    alone = member.where("load > 1").select("id").distinct().join(groups, "id", "left_anti").select("id", F.col("id").alias("comp"), F.lit(1).cast("long").alias("parts"))
    chosen = scratch.cut(texts.join(groups.union(alone), "id").select("id", "text", "comp", "parts"), "chosen")

    def verify(rows: DataFrame, work: Callable, *more: str) -> DataFrame:
        dealt = rows.select("id", "text", "block", *more).repartition("block").sortWithinPartitions("block", "id")
        return dealt.mapInPandas(_by_run("block", work), "a long, b long")

    part = lambda turn: F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts"))
    edges = scratch.cut(verify(chosen.withColumn("block", F.xxhash64("comp", part(1))), _verified), "edges-1")
    classes = components(edges, scratch, "classes-1")
    large = groups.where("parts > 1")
    if not large.isEmpty():
        # a few leaders of each class of a large group meet
        of = large.select("id", F.col("comp").alias("large")).join(classes, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        size = of.groupBy("large", "comp").count()
        lead = of.join(size, ["large", "comp"]).where(F.pmod(F.xxhash64("id", F.lit(2)), F.col("count")) < LEADERS)
        lead = scratch.cut(lead.select("id", "large").join(sigs.select("id", load), "id"), "leaders")
        parts = lead.groupBy("large").agg(F.ceil(F.sum("load")).alias("parts"))
        lead = lead.join(parts, "large").select("id", F.xxhash64("large", part(3)).alias("block"))
        edges = edges.union(scratch.cut(verify(chosen.join(lead, "id"), _verified), "edges-2"))
        classes = components(edges, scratch, "classes-2")
    wide = full.where("load > 1").select("key", F.lit(True).alias("wide")).union(member.join(large, "id", "left_semi").select("key", F.lit(True))).distinct()
    if not wide.isEmpty():
        # buckets that still span several classes: those outside the largest meet all
        named = scratch.cut(member.drop("load").join(wide, "key", "left_semi").join(classes, "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(sigs.select("id", load), "id"), "named")
        sizes = named.groupBy("key", "comp").agg(F.sum("load").alias("load"))
        open_ = sizes.groupBy("key").agg(F.sum("load").alias("all"), F.count("*").alias("classes"), F.max_by("comp", F.struct("load", "comp")).alias("main"), F.max("load").alias("most"))
        open_ = open_.where("classes > 1").select("key", "main", F.ceil("all").alias("wide"), F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("most"))).alias("deep"))
        rest = named.join(open_, "key").withColumn("minor", F.col("comp") != F.col("main"))
        across, down = F.pmod(F.xxhash64("id", F.lit(8)), F.col("wide")), F.pmod(F.xxhash64("id", F.lit(9)), F.col("deep"))
        cell = lambda x, y: F.xxhash64("key", x, y)
        row = F.transform(F.sequence(F.lit(0).cast("long"), F.col("deep") - 1), lambda y: F.struct(cell(across, y).alias("block"), (F.col("minor") & (y == down)).alias("minor")))
        column = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda x: F.struct(cell(x, down).alias("block"), F.lit(True).alias("minor")))
        at = F.explode(F.when(F.col("minor"), F.array_union(row, column)).otherwise(row)).alias("at")
        cells = rest.select("id", "comp", "band", at).select("id", "comp", "band", "at.block", "at.minor")
        met = cells.join(sigs.select("id", "sig"), "id").repartition("block").sortWithinPartitions("block", "id").mapInPandas(_by_run("block", _promising), "a long, b long")
        met = scratch.cut(met.select(F.col("a").alias("id"), F.col("b").alias("block")), "met").join(named.select("id", "comp").distinct(), "id")
        missed = scratch.cut(verify(chosen.select("id", "text").join(met, "id"), _missed, "comp"), "missed")
        if not missed.isEmpty():
            classes = components(edges.union(missed), scratch, "classes-3")
    final = scratch.cut(reps.select("digest", "rep").join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("class_id")), "final")
    scratch.drop("buckets", "members", "grouped", "chosen", "edges-1", "edges-2", "leaders", "named", "met", "missed")
    if repeated:
        signed = signed.select("id").join(one.select("id", "digest"), "id")
    return signed.select(F.col("id").alias("doc_id"), "digest").join(final, "digest").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class (rows that share its id all stay), with its own columns."""
    (own,) = own_names(docs, "id")
    gone = near_duplicates(spark, docs).where("not kept").select(F.col("doc_id").alias(own))
    return docs.join(gone, docs["doc_id"] == F.col(own), "left_anti")
