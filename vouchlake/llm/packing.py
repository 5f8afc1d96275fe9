"""Packing into fixed windows by non-negative least squares.

Documents are tokenised in blocks of bounded size. Whole windows are cut from
long documents; the remainders form a histogram of quantised lengths. Shallow
length combinations that fill a window are enumerated, their repeat counts
solved by non-negative least squares against the histogram and rounded down;
what is left is packed greedily, cut where a window fills. The last window of a
partition is cut into power-of-two sequences, which need no padding.
A block never waits for another, so no shuffle is needed and a lost task is
repeated alone. Null text is empty: one closing id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from vouchlake.llm.bpe import Merger
from vouchlake.llm.scratch import small_batches

WINDOW, CLOSE, BINS, BLOCK = 4096, 2, 16, 2_000_000


class Encoder:
    """Ids as the tokenizers library gives them: plain chunks between spaces go
    through the batched merger, any other chunk through the library."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.merger, self.full = Merger(path), Tokenizer.from_file(path)
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
        self.names = list(self.merger.special)
        self._reset()

    def _reset(self) -> None:
        self.known, self.pool, self.start, self.size, self.used = {}, np.empty(1 << 20, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        parts, owners, odd = [], [], []
        for i, c in enumerate(new):
            if self.plain(c) and not any(s in c for s in self.names):
                ws = self.find(c.lower())
                parts += ws
                owners += [i] * len(ws)
            else:
                odd.append(i)
        ids, lens = self.merger.merge([w.encode() for w in parts]) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
        size = np.bincount(np.array(owners, np.int64), weights=lens, minlength=len(new)).astype(np.int64) if owners else np.zeros(len(new), np.int64)
        extra = [self.full.encode(new[i], add_special_tokens=False).ids for i in odd]
        start = np.cumsum(size) - size + self.used
        at = self.used + len(ids)
        for i, e in zip(odd, extra, strict=True):
            start[i], size[i] = at, len(e)
            at += len(e)
        while at > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        if extra:
            self.pool[self.used + len(ids) : at] = np.concatenate([np.array(e, np.uint32) for e in extra])
        self.used = at
        base = len(self.known)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.known.update((c, base + i) for i, c in enumerate(new))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > 400_000:
            self._reset()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list({c for cs in split for c in cs}.difference(self.known))
        if new:
            self._learn(new)
        out = []
        for cs in split:
            idx = np.fromiter(map(self.known.__getitem__, cs), np.int64, len(cs))
            size, start = self.size[idx], self.start[idx]
            shift = np.repeat(start - (np.cumsum(size) - size), size)
            out.append(np.append(self.pool[shift + np.arange(len(shift))], np.uint32(CLOSE)))
        return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """min |ax - b| over x >= 0, by coordinate descent."""
    q, c, x = a.T @ a, a.T @ b, np.zeros(a.shape[1])
    diag = np.maximum(np.diag(q), 1e-12)
    for _ in range(rounds):
        old = x.copy()
        for j in range(len(x)):
            x[j] = max(0.0, x[j] + (c[j] - q[j] @ x) / diag[j])
        if np.abs(x - old).max(initial=0) < 1e-3:
            break
    return x


def combinations(bins: int = BINS, depth: int = 4) -> list[tuple[int, ...]]:
    """Ways to fill `bins` units with at most `depth` pieces, longest first."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, made: tuple[int, ...]) -> None:
        if left == 0:
            out.append(made)
        elif len(made) < depth:
            for n in range(min(left, most), 0, -1):
                grow(left - n, n, (*made, n))

    grow(bins, bins, ())
    return out


COMBOS = combinations()


def plan(lengths: list[int]) -> list[list[int]]:
    """Groups of piece numbers that fit one window together; the residue is single."""
    unit = WINDOW // BINS
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        waiting.setdefault(-(-n // unit), []).append(i)
    hist = np.array([len(waiting.get(k, ())) for k in range(1, BINS + 1)], float)
    a = np.array([[c.count(k) for c in COMBOS] for k in range(1, BINS + 1)], float)
    groups = []
    for combo, n in zip(COMBOS, np.floor(nnls(a, hist, 30)).astype(int), strict=True):
        for _ in range(n):
            if any(len(waiting.get(k, ())) < combo.count(k) for k in set(combo)):
                break
            groups.append([waiting[k].pop() for k in combo])
    rest = sorted((i for v in waiting.values() for i in v), key=lambda i: (-lengths[i], i))
    return groups + [[i] for i in rest]


def pack(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seq, fill = Encoder(path), (TaskContext.get().partitionId() << 33), 0
        block, held = [], 0
        open_: list[list] = []  # pieces of the window being filled
        rows: list[tuple] = []

        def emit(piece: tuple, at: int, to: int) -> None:
            doc, start, ids, total = piece
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, to, at))

        def close() -> None:
            nonlocal seq, fill
            at = 0
            for p in open_:
                emit(p, at, seq)
                at += len(p[2])
            if open_:
                seq += 1
            open_.clear()
            fill = 0

        def put(piece: tuple) -> None:
            nonlocal fill
            doc, start, ids, total = piece
            while len(ids):
                n = min(len(ids), WINDOW - fill)
                open_.append((doc, start, ids[:n], total))
                fill += n
                start, ids = start + n, ids[n:]
                if fill == WINDOW:
                    close()

        def flush() -> None:
            nonlocal seq, block, held
            pieces = []
            for doc, ids in block:
                total, whole = len(ids), len(ids) // WINDOW * WINDOW
                for s in range(0, whole, WINDOW):
                    emit((doc, s, ids[s : s + WINDOW], total), 0, seq)
                    seq += 1
                if total > whole:
                    pieces.append((doc, whole, ids[whole:], total))
            rest = []
            groups = plan([len(p[2]) for p in pieces])
            for g in groups:
                if len(g) == 1:
                    rest.append(pieces[g[0]])
            for g in groups:
                if len(g) > 1:
                    at = 0
                    for i in g:
                        emit(pieces[i], at, seq)
                        at += len(pieces[i][2])
                    while at < WINDOW and rest:  # the gap takes the head of a residual
                        doc, start, ids, total = rest.pop()
                        n = min(len(ids), WINDOW - at)
                        emit((doc, start, ids[:n], total), at, seq)
                        at += n
                        if n < len(ids):
                            rest.append((doc, start + n, ids[n:], total))
                    seq += 1
            for p in rest:
                put(p)
            block, held = [], 0

        def out() -> pd.DataFrame:
            got = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return got

        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"].tolist(), encoder.encode(pdf["text"].fillna("").tolist()), strict=True):
                block.append((doc, ids))
                held += len(ids)
            if held > BLOCK:
                flush()
                yield out()
        flush()
        tail, size = list(open_), fill
        open_.clear()
        while size:  # powers of two need no padding
            n = 1 << (size.bit_length() - 1)
            at = 0
            while at < n:
                doc, start, ids, total = tail.pop(0)
                k = min(len(ids), n - at)
                emit((doc, start, ids[:k], total), at, seq)
                at += k
                if k < len(ids):
                    tail.insert(0, (doc, start + k, ids[k:], total))
            seq, size = seq + 1, size - n
        yield out()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, schema)
