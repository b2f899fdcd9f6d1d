"""Each query of the subpackage that has SQL against it, on the smallest tables."""

import pytest

from capledger.llm import queries

duckdb = pytest.importorskip("duckdb")
TABLES = ("documents", "benchmark", "pages")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, sf, name):
    shown = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else repr(v)
    df = queries.queries()[name](spark, sf)
    found = con.sql(queries.oracle_sql()[name])
    order = [found.columns.index(c) for c in sorted(found.columns)]
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in order) for r in found.fetchall())
