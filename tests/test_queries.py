"""Every named query with SQL against another engine on the smallest tables."""

import math
import os

import duckdb
import pytest

from lithograph.plans import oracles, product_queries, queries

SQL, QUERIES = oracles.SQL | product_queries.SQL, queries.QUERIES | product_queries.QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v.item() if hasattr(v, "item") else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    told = db.execute(SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    assert ordered(tuple(r[names.index(c)] for c in columns) for r in told.fetchall()) == ordered(got.select(*columns).collect())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
