"""Queries of the training-data operators against their SQL."""

import os

import duckdb
import pytest

from plumbline.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    got = QUERIES[name](spark, DIR)
    want = c.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda cols, data: sorted((tuple(str(r[cols.index(k)]) for k in order) for r in data))
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
