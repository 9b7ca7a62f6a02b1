"""Every catalogue query with SQL, held against DuckDB on the smallest tables."""

import duckdb
import pytest

from quillstack import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark pages labels conversations embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = db.sql(plans.ORACLE_SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
