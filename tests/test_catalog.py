"""Every query of the catalog against its SQL, at the smallest size."""

import math

import duckdb
import pytest

from calltide.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(float(v)) if isinstance(v, float) else str(v)


def test_every_query_with_sql_is_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 120


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [list(rel.columns).index(c) for c in columns]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and any(v is not None for r in rows for v in r), name


def test_every_embedding_is_stored_or_counted_as_a_run(spark, con):
    got = catalog.queries()["v03_store_or_merge"](spark, SF).collect()
    ids = {r[0] for r in con.sql("SELECT vec_id FROM embeddings").fetchall()}
    assert sum(r["runs"] for r in got) == len(ids)
    assert {r["id"] for r in got} <= ids and {i for i in ids if i % 20} <= {r["id"] for r in got}
