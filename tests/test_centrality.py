"""Centralities against plain versions on small graphs."""

from itertools import product

import numpy as np
import pytest

from vouchlake.operators import centrality, graph

EDGES = [(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (3, 5), (5, 1), (2, 2), (6, 1), (1, 2)]


def _plain():
    """Distances and numbers of shortest paths by powers of the adjacency matrix."""
    a = np.zeros((7, 7))
    for s, d in EDGES:
        a[s, d] = s != d
    hops, paths, power = {}, {}, np.eye(7)
    for h in range(1, 7):
        power = power @ a
        for s, d in product(range(1, 7), repeat=2):
            if s != d and (s, d) not in hops and power[s, d]:
                hops[s, d], paths[s, d] = h, int(power[s, d])
    return hops, paths


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def test_paths(edges):
    hops, paths = _plain()
    got = centrality.shortest_paths(edges).collect()
    assert {(r.src, r.dst): (r.hops, r.paths) for r in got} == {k: (hops[k], paths[k]) for k in hops} and len(got) == len(hops)


def test_closeness_and_betweenness(edges):
    hops, paths = _plain()
    for v, got in {r.node: r.closeness for r in centrality.closeness(edges).collect()}.items():
        d = [h for (_, t), h in hops.items() if t == v]
        assert got == pytest.approx(len(d) / sum(d) * len(d) / 5 if d else 0)
    for v, got in {r.node: r.betweenness for r in centrality.betweenness(edges).collect()}.items():
        want = sum(paths[s, v] * paths[v, t] / paths[s, t] for s, t in hops if v not in (s, t) and (s, v) in hops and (v, t) in hops and hops[s, v] + hops[v, t] == hops[s, t])
        assert got == pytest.approx(want / 20)


def test_influence(spark, edges):
    a = np.zeros((6, 6))
    for s, d in EDGES:
        a[s - 1, d - 1] = 1
    x = np.ones(6) / 6
    for _ in range(200):
        x = x + a.T @ x
        x /= np.linalg.norm(x)
    got = {r.node: r.influence for r in centrality.influence(edges).collect()}
    assert [got[i] for i in range(1, 7)] == pytest.approx(x.tolist(), abs=1e-4)
    assert centrality.influence(edges.where("src < 0")).count() == 0
    with pytest.raises(ValueError, match="no fixed point"):
        centrality.influence(edges, rounds=1)


@pytest.mark.parametrize(("n", "m", "seed"), [(30, 25, 1), (12, 40, 2), (1, 1, 3)])
def test_closure(spark, n, m, seed):
    rnd = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rnd.integers(0, n, (m, 2))]
    if seed == 1:
        pairs += [(100 + i, 101 + i) for i in range(20)]
    reach = set(pairs)
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            break
        reach |= more
    got = [(r.src, r.dst) for r in graph.closure(spark.createDataFrame(pairs, "src long, dst long")).collect()]
    assert sorted(got) == sorted(reach)


def test_closure_of_nothing(spark):
    assert graph.closure(spark.createDataFrame([], "src long, dst long")).count() == 0
