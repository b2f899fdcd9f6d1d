"""Each query against its SQL, on the smallest tables."""

import math

import pytest

from capledger.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6))
    return "null" if v is None else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    mine = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = con.sql(registry.oracle_sql()[name])
    order = [found.columns.index(c) for c in sorted(found.columns)]
    assert sorted(df.columns) == sorted(found.columns)
    assert mine == sorted(tuple(norm(r[i]) for i in order) for r in found.fetchall())
