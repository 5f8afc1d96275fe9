"""Fingerprints against a plain version, over many ranges and awkward rows."""

import hashlib
import random

import pytest

from vouchlake.llm import fingerprint as fp


def plain_likeness(a, b):
    """Edit distance without substitution by the plain table, at a common block size."""

    def alike(x, y):
        if not any(x[i : i + 4] in y for i in range(len(x) - 3)):
            return 0.0
        best = [0] * (len(y) + 1)
        for c in x:
            last = best[:]
            for j, d in enumerate(y, 1):
                best[j] = last[j - 1] + 1 if c == d else max(last[j], best[j - 1])
        return 2 * best[-1] / (len(x) + len(y))

    if a == b:
        return 1.0
    (x, x1, x2, _), (y, y1, y2, _) = a.split(":"), b.split(":")
    sigs = {int(x): x1, 2 * int(x): x2}, {int(y): y1, 2 * int(y): y2}
    return max((alike(sigs[0][k], sigs[1][k]) for k in set(sigs[0]) & set(sigs[1])), default=0.0)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_every_row_against_the_plain_version(spark, n):
    rnd = random.Random(n)
    rows = [(i * 3, " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.choice([0, 1, 3, 50, 400])))) for i in range(n)]
    rows = [(i, None if i % 7 == 3 else t) for i, t in rows]
    if n > 2:
        rows += [(6, "again é"), (6, "again é"), (9, rows[5][1]), (9, "y " * 40_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, part string").repartition(5)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], hashlib.sha256(r[1].encode()).digest()))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        f, fe, fn = fp.fingerprint(t), fp.fingerprint(e), fp.fingerprint(nxt)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fe, plain_likeness(f, fe), plain_likeness(f, fn)))
    got = [tuple(r) for r in fp.compare_with_next(spark, docs).collect()]
    assert sorted(got) == sorted(want)


def test_short_texts_are_not_alike_by_chance():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(k)) for k in (2, 4, 8) for _ in range(2000)]
    alike = [fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) for a, b in zip(texts[::2], texts[1::2], strict=True) if a != b]
    assert max(alike) < 1.0 and sum(alike) / len(alike) < 0.01
    long = " ".join(f"word{i}" for i in range(500))
    assert fp.likeness(fp.fingerprint(long), fp.fingerprint(long.replace("word250", "other"))) > 0.9
