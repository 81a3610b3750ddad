"""Every registered query with an oracle matches DuckDB on sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF0001
from themeloom.plans import registry

TABLES = "documents embeddings pages labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n in registry.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    cols = df.columns
    rows = df.collect()
    r = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(ocols)
    order = sorted(cols)
    a = sorted((tuple(norm(x[cols.index(c)]) for c in order) for x in rows), key=repr)
    b = sorted((tuple(norm(x[ocols.index(c)]) for c in order) for x in r.fetchall()), key=repr)
    assert a == b


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "bm25_score" in df.columns
