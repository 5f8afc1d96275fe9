"""Plans whose exchanges, broadcasts and tasks must not grow with a small file's content."""

import random

import duckdb
import pytest

from vouchlake.operators import centrality, correlations, graph, nested_counts, vulnerabilities
from vouchlake.plans import analytics, certificates, features


def _tables(folder, **tables):
    """Tables of a query, from SQL that makes their rows; the folder and the other engine's views."""
    db = duckdb.connect()
    for name, sql in tables.items():
        db.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), db


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _same(df, rows):
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rows, key=key)


def test_ngram_overlap_broadcasts_nothing(spark, tmp_path):
    names = "['abab', 'babab', NULL, 'a', 'ab', '', 'aab', 'zz']"
    folder, db = _tables(tmp_path, part=f"SELECT nullif(i, 30) // (CASE WHEN i > 40 THEN 2 ELSE 1 END) AS p_partkey, ({names})[i % 8 + 1] AS p_name FROM range(60) t(i)")
    got = analytics.QUERIES["ngram_overlap"](spark, folder)
    assert "Broadcast" not in _plan(got)
    _same(got, db.sql(analytics.ORACLE_SQL["ngram_overlap"]).fetchall())


@pytest.mark.parametrize("name", ["labelled_graphs", "matching_precision", "id_vote"])
def test_lines_are_dealt_before_they_are_counted(spark, name):
    """The scan's few tasks hold no counts: the innermost aggregate stands over the exchange of lines."""
    sf = "/root/testdata/sf0.001"
    plan = (certificates.QUERIES | features.QUERIES)[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    # the lines' scan, then what stands over it
    for at in (i for i, x in enumerate(plan) if "Scan parquet" in x and "l_orderkey" in x):
        over = [x for x in reversed(plan[:at]) if "Exchange" in x or "Aggregate" in x or "Window" in x]
        assert "Exchange" in over[0] and "REPARTITION_BY_NUM" in over[0], over[0]


def test_nested_totals_are_dealt_by_key_once(spark):
    """One exchange, of a given number of parts, feeds the window and both groupings; nothing is joined."""
    plan = nested_counts.nested_totals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1 and "Join" not in plan, plan


def test_configured_lookups_count_no_hits(spark, monkeypatch):
    """Lines are dealt by certificate first, and what the names meet is not counted: no part is widened to its hits."""
    monkeypatch.setattr(vulnerabilities, "cut", lambda df: df)
    plan = features.configured_vulnerabilities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "Expand" not in plan
    plan = plan.splitlines()
    for at in (i for i, x in enumerate(plan) if "Scan parquet" in x and "l_orderkey" in x):
        over = [x for x in reversed(plan[:at]) if "Exchange" in x or "Aggregate" in x]
        assert "REPARTITION_BY_NUM" in over[0], over[0]


@pytest.mark.parametrize("few", [0, 20_000])
def test_configured_lookups_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(vulnerabilities, "FEW", few)
    draw, pick = random.Random(5), lambda k, n, of: [f"{of}{draw.randrange(n)}" for _ in range(draw.randrange(k))]
    certs = [(f"d{i % 60}", pick(6, 12, "u")) for i in range(80)]  # some in two rows
    cves = [(f"v{i}", [[pick(4, 14, "c") for _ in range(draw.randrange(4))] for _ in range(draw.randrange(3))], pick(2, 14, "c")) for i in range(40)]
    uris = {f"c{i}": [f"u{i}", f"u{i // 2}"] for i in range(13)}
    of = {}
    for d, us in certs:
        of.setdefault(d, set()).update(us)
    met = lambda us, any_of: any(u in us for c in any_of for u in uris.get(c, ()))
    want = {(d, v) for d, us in of.items() for v, confs, plain in cves if met(us, plain) or any(conf and all(met(us, p) for p in conf) for conf in confs)}
    got = vulnerabilities.related_cves(
        spark.createDataFrame(certs, "dgst string, uris array<string>"), spark.createDataFrame(cves, "cve_id string, configurations array<array<array<string>>>, criteria array<string>"),
        spark.createDataFrame(list(uris.items()), "criteria_id string, uris array<string>"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["transitive_attribute_propagation", "closeness_centrality", "betweenness_centrality", "rollup_to_top_parent"])
def test_rounds_over_a_graph_broadcast_no_layer(spark, monkeypatch, name):
    """Of a small table each round's plan would be a broadcast join; betweenness does not join pairs with pairs on their middle."""
    plans = []
    for module in (graph, centrality):
        monkeypatch.setattr(module, "cut", lambda df, put=module.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or put(df))
    (graph.QUERIES | centrality.QUERIES)[name](spark, "/root/testdata/sf0.001")
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert joins and all("strategy=merge" in line for line in joins), joins


def test_correlations_deal_pairs_before_they_are_counted(spark, monkeypatch):
    """Pairs that hardly repeat are not counted in the few tasks of a join."""
    plans = []
    monkeypatch.setattr(correlations, "cut", lambda df, put=correlations.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df))
    correlations.requirement_correlations(spark, "/root/testdata/sf0.001")
    plan = plans[0].splitlines()
    over = [x for x in plan if "Exchange" in x or "Aggregate" in x or "Join" in x]
    assert over.index(next(x for x in over if "REPARTITION_BY_NUM" in x)) < over.index(next(x for x in over if "Join" in x)), over
    for at in (i for i, x in enumerate(plan) if "Scan parquet" in x):
        near = [x for x in reversed(plan[:at]) if "Exchange" in x or "Aggregate" in x]
        assert "REPARTITION_BY_NUM" in near[0], near[0]
