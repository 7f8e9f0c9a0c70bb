"""Every query of the core against its SQL, on the smallest tables."""

import os

import pytest

from quern.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return list(map(plain, v)) if isinstance(v, list) else round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.R.queries))
def test_query(spark, duck, name):
    df = catalog.R.queries[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in catalog.R.sql:
        assert got or name == "near_pairs"
        return
    result = duck.execute(catalog.R.sql[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=repr)
