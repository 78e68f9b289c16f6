"""Every linkage query against its SQL."""

import duckdb
import pytest

from hushjoin.plans import queries as Q

SF = "/root/testdata/sf0.001"


def norm(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(None if x is None or x != x else round(x, 9) if isinstance(x, float) else x for x in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "supplier", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


@pytest.mark.parametrize("name", Q.queries())
def test_query_matches_sql(spark, con, name):
    assert norm(Q.queries()[name](spark, SF).toPandas()) == norm(con.execute(Q.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
