"""Each training-data query that SQL can express against DuckDB, on whole tables."""

import os

import duckdb
import pytest

from headroom.llm import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(found.columns)
    names = sorted(got.columns)
    want = sorted(map(repr, (rounded(r) for r in con.sql(f"select {', '.join(names)} from found").fetchall())))
    assert sorted(repr(rounded(r)) for r in got.select(names).collect()) == want
