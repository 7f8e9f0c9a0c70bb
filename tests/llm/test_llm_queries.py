"""The pN_ queries on the smallest tables, against SQL where there is some."""

import os

import pytest

from quern.llm.queries import R

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
COLUMNS = {
    "p1_found": ["first_idx", "idx"], "p2_found": ["id_a", "id_b"], "p3_found": ["id", "page", "line_no"], "p4_found": ["kind", "item_id", "need"],
    "p5_found": ["source"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, name):
    df = R.queries[name](spark, FOLDER)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got or name in ("p2_found", "p8_found")
    if name in R.sql:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
        result = con.execute(R.sql[name])
        at = [[d[0] for d in result.description].index(c) for c in df.columns]
        assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
