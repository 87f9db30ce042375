"""Queries against the SQL registered for them."""

import os

import duckdb
import pytest

from refold.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*sorted(got.columns)).collect()) == plain(want.select(", ".join(f'"{c}"' for c in sorted(want.columns))).fetchall())
