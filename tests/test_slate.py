"""Every named query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tomoframe.plans import extra, files, more, slate, volumes  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(slate.SQL))
def test_query_equals_sql(spark, duck, name):
    df = slate.QUERIES[name](spark, SF)
    want = duck.execute(slate.SQL[name])
    cols, types = [d[0] for d in want.description], {d[0]: str(d[1]) for d in want.description}
    assert sorted(cols) == sorted(df.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    assert {c: kinds[t] for c, t in df.dtypes} == types
    order = sorted(cols)
    a = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(slate.QUERIES) - set(slate.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert slate.QUERIES[name](spark, SF).count() > 0
