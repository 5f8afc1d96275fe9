"""Each plan gives the rows that its SQL gives in another engine."""

import duckdb
import pytest

from vouchlake.operators import graph
from vouchlake.plans import analytics, pages, relational

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in relational.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [*relational.PLANS, *analytics.PLANS, *graph.ORACLE_SQL, *pages.ORACLE_SQL])
def test_plan_matches_sql(spark, db, name):
    both, sql = relational.QUERIES | analytics.QUERIES | graph.QUERIES | pages.QUERIES, relational.ORACLE_SQL | analytics.ORACLE_SQL | graph.ORACLE_SQL | pages.ORACLE_SQL
    got, want = both[name](spark, SF).toPandas(), db.sql(sql[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].astype(str).values.tolist())) == sorted(map(str, want[cols].astype(str).values.tolist()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
