"""Every query of plans against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from ridgeline.plans import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = all_queries()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return (repr(round(v, 9)) if not math.isnan(v) else "nan") if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, oracle):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert name in SQL
    found = oracle.sql(SQL[name])
    assert sorted(found.columns) == cols
    place = [found.columns.index(c) for c in cols]
    assert mine == sorted(tuple(_plain(r[i]) for i in place) for r in found.fetchall())


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
