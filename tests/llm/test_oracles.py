"""The text queries against their SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from emberlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    a, b = order(tuple(r[c] for c in columns) for r in got.collect()), order(tuple(r[k] for k in at) for r in want.fetchall())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(math.isclose(p, q, rel_tol=1e-12) if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y, strict=True))
