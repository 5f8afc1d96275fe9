"""Byte-pair merging of many pre-tokens at once in numpy.

All pre-tokens of a batch lie in one flat (ragged) array of symbol ids. Every
round finds, for each sequence, the pair of lowest rank and merges it in all
sequences together; sequences without a pair that can merge leave the array.
A merge can only create pairs of higher rank than its own, so merging all
occurrences of a sequence's lowest pair in one round gives the same symbols as
the usual one-at-a-time procedure.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int64(1 << 40)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take
    the code points from 256 on, in order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class PairTable:
    """Open-addressed table from a pair of symbol ids to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, ~np.uint64(0), dtype=np.uint64)
        self.rank = np.full(1 << bits, _NONE, dtype=np.int64)
        self.to = np.zeros(1 << bits, dtype=np.int64)
        slot = ((keys * _MIX) >> self.shift).astype(np.int64)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == ~np.uint64(0)
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]], self.rank[slot[put]], self.to[slot[put]] = keys[put], put, merged[put]
            todo = todo[~(free & first)]
            slot[todo] = (slot[todo] + 1) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slot = ((keys * _MIX) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == keys, slot, -1)
        miss = np.flatnonzero((out < 0) & (self.keys[slot] != ~np.uint64(0)))
        for _ in range(self.probes):
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & self.mask
            got = self.keys[slot[miss]]
            out[miss[got == keys[miss]]] = slot[miss[got == keys[miss]]]
            miss = miss[(got != keys[miss]) & (got != ~np.uint64(0))]
        return out


class Merger:
    """A byte-level BPE vocabulary file of the ``tokenizers`` library, for batches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        look = lambda names: np.array([vocab[n] for n in names], dtype=np.int64)
        self.table = PairTable(look([a for a, _ in pairs]), look([b for _, b in pairs]), look([a + b for a, b in pairs]))
        self.inner = look(byte_symbols())
        self.last = look([s + suffix for s in byte_symbols()])
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the surviving symbols of all words, one after the other."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        out_len = size.copy()
        final = [np.empty(0, dtype=np.int64)]
        final_seq = [np.empty(0, dtype=np.int64)]
        seq = np.flatnonzero(size > 0)
        lens = size[seq]
        ids = self.inner[flat]
        if len(seq):
            ends = np.cumsum(lens) - 1
            ids[ends] = self.last[flat[ends]]
        at = self._ranks(ids, lens)
        while len(seq):
            starts = np.cumsum(lens) - lens
            rank = np.where(at >= 0, self.table.rank[at], _NONE)
            low = np.minimum.reduceat(rank, starts)
            live = low < _NONE
            if not live.all():
                per = np.repeat(live, lens)
                done = ~live
                out_len[seq[done]] = lens[done]
                final.append(ids[~per])
                final_seq.append(np.repeat(seq[done], lens[done]))
                ids, at, rank, seq, lens, low = ids[per], at[per], rank[per], seq[live], lens[live], low[live]
                if not len(seq):
                    break
                starts = np.cumsum(lens) - lens
            hit = rank == np.repeat(low, lens)
            place = np.flatnonzero(hit)
            if len(place) > 1 and (np.diff(place) == 1).any():
                # in a run of overlapping hits every second one is taken, from the left
                fresh = np.concatenate(([True], np.diff(place) != 1))
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - run) % 2 == 0]
            ids[place] = self.table.to[at[place]]
            keep = np.ones(len(ids), dtype=bool)
            keep[place + 1] = False
            gone = np.add.reduceat((~keep).astype(np.int64), starts)
            touched = np.zeros(len(ids), dtype=bool)
            touched[place] = True
            lens = lens - gone
            ids, at, touched = ids[keep], at[keep], touched[keep]
            starts = np.cumsum(lens) - lens
            again = touched.copy()
            again[:-1] |= touched[1:]
            tail = starts + lens - 1
            again[tail] = False
            at[tail] = -1
            where = np.flatnonzero(again)
            at[where] = self.table.find(ids[where], ids[where + 1])
        ids, owner = np.concatenate(final), np.concatenate(final_seq)
        return ids[np.argsort(owner, kind="stable")], out_len

    def _ranks(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        at = np.full(len(ids), -1, dtype=np.int64)
        if len(ids) > 1:
            inside = np.ones(len(ids), dtype=bool)
            inside[np.cumsum(lens) - 1] = False
            where = np.flatnonzero(inside)
            at[where] = self.table.find(ids[where], ids[where + 1])
        return at
