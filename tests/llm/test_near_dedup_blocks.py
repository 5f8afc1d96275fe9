"""Classes of chains of edits, larger than one block, against all pairs."""

import random
import re

import pytest

from vouchlake.llm import near_dedup


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


@pytest.mark.parametrize("block", [4, 512])
def test_chains_beyond_a_block(spark, monkeypatch, block):
    rnd, rows = random.Random(4), [(0, None), (1, ""), (2, "a b"), (3, "a b")]
    for g in range(4):
        words = [f"w{rnd.randrange(3000)}" for _ in range(120)]
        for _ in range(30):
            words = list(words)
            for _ in range(1 + g % 2):
                words[rnd.randrange(120)] = f"w{rnd.randrange(3000)}"
            rows.append((len(rows), " ".join(words)))
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(label))
