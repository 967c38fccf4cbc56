"""The queries of this subpackage against their SQL, on the smallest tables."""

import duckdb
import pytest

from lumenframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    found = con.execute(queries.ORACLES[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == names
    want = sorted((tuple(row[at.index(c)] for c in names) for row in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
