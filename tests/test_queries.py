import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 9) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_equals_sql(spark, db, name):
    rows = QUERIES[name](spark, SF)
    want = db.sql(ORACLE[name])
    names = sorted(rows.columns)
    assert names == sorted(want.columns)
    place = [want.columns.index(n) for n in names]
    assert sorted(repr([norm(r[n]) for n in names]) for r in rows.collect()) == sorted(repr([norm(r[i]) for i in place]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
