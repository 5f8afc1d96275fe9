"""Components, chains and triangles against plain versions on random graphs."""

import itertools
import random

import pytest

from vouchlake.operators import cycles


def reachable(edges):
    out = {n: {d for s, d in edges if s == n} for n in {x for e in edges for x in e}}
    while True:
        more = {n: m | {d for x in m for d in out[x]} for n, m in out.items()}
        if more == out:
            return out
        out = more


def frame(spark, edges):
    return spark.createDataFrame([(*e, "clash") for e in edges], "src long, dst long, node string")


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(28)] + [(100, 101), (101, 102), (102, 100), (102, 103), (104, 104)]
    edges += edges[:3]
    reach = reachable(edges)
    mutual = {n: {n} | {m for m in r if n in reach[m]} for n, r in reach.items()}
    got = {r["node"]: (r["component"], r["size"]) for r in cycles.strong_components(frame(spark, edges)).collect()}
    assert got == {n: (min(m), len(m)) for n, m in mutual.items()}
    assert {r["node"] for r in cycles.on_cycles(frame(spark, edges)).collect()} == {n for n in reach if n in reach[n]}
    over = {(got[s][0], got[d][0]) for s, d in edges if got[s][0] != got[d][0]}
    condensed = cycles.condensed(frame(spark, edges))
    assert {tuple(r) for r in condensed.collect()} == over

    def depth(n):
        return max((depth(s) + 1 for s, d in over if d == n), default=0)

    assert {tuple(r) for r in cycles.chains(condensed).collect()} == {(n, depth(n)) for n in {x for e in over for x in e}}
    links = {frozenset(e) for e in edges if e[0] != e[1]}
    nodes = {x for e in links for x in e}
    found = {frozenset(t) for t in itertools.combinations(sorted(nodes), 3) if all(frozenset(p) in links for p in itertools.combinations(t, 2))}
    rows = [frozenset(r) for r in cycles.triangles(frame(spark, edges)).collect()]
    assert len(rows) == len(found) and set(rows) == found


def test_empty_and_cyclic(spark):
    none = frame(spark, []).select("src", "dst")
    assert cycles.strong_components(none).count() == cycles.chains(none).count() == cycles.triangles(none).count() == 0
    row = cycles.shape(none).first()
    assert (row["nodes"], row["triangles"], row["density"], row["transitivity"]) == (0, 0, None, None)
    with pytest.raises(ValueError, match="cycle"):
        cycles.chains(frame(spark, [(1, 2), (2, 1)]))
