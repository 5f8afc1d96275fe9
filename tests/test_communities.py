"""Communities against a plain version of the same moves, and on planted circles."""

import random
from collections import defaultdict

from vouchlake.operators import communities as co


def plain(edges):
    links = defaultdict(int)
    for a, b, w in edges:
        links[a, b] += w
        links[b, a] += w
    whole = {n: n for n, _ in links}

    def quality(of):
        m, own, size = 0, 0, defaultdict(int)
        for (a, b), w in links.items():
            m, own = m + w, own + w * (of[a] == of[b])
            size[of[a]] += w
        return m * own - sum(s * s for s in size.values())

    while True:
        k = defaultdict(int)
        for (a, _), w in links.items():
            k[a] += w
        total, of = sum(k.values()), {n: n for n in k}
        best, idle, turn = quality(of), 0, 0
        while idle < 2:
            size = defaultdict(int)
            for n, c in of.items():
                size[c] += k[n]
            step = {}
            for n, now in of.items():
                near = defaultdict(int, {now: 0})
                for (a, b), w in links.items():
                    if a == n and b != n:
                        near[of[b]] += w
                gain = {c: w * total - k[n] * (size[c] - (k[n] if c == now else 0)) for c, w in near.items() if c == now or (c < now) == (turn % 2 == 0)}
                top = min(gain, key=lambda c: (-gain[c], c))
                step[n] = top if gain[top] > gain[now] else now
            q = quality(step)
            of, best, idle = (step, q, 0) if q > best else (of, best, idle + 1)
            turn += 1
        if all(n == c for n, c in of.items()):
            break
        whole = {n: of[at] for n, at in whole.items()}
        fresh = defaultdict(int)
        for (a, b), w in links.items():
            fresh[of[a], of[b]] += w
        links = fresh
    least = {}
    for n, at in whole.items():
        least[at] = min(n, least.get(at, n))
    return {n: least[at] for n, at in whole.items()}


def test_as_the_plain_version(spark):
    rng = random.Random(6)
    edges = [(a, b, rng.randint(1, 3)) for a in range(24) for b in range(a) if rng.random() < (0.6 if a // 6 == b // 6 else 0.06)] + [(3, 3, 2), (50, 51, 1)]
    frame = spark.createDataFrame([(*e, "clash") for e in edges + [(None, 1, 1)]], "src long, dst long, weight int, node string")
    got = co.communities(frame.repartition(5))
    want = plain(edges)
    assert {r["node"]: r["community"] for r in got.collect()} == want
    assert co.modularity(frame, got) > 0.4 and len(set(want.values())) <= 6


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert co.communities(none).count() == 0 and co.modularity(none, co.communities(none)) is None
