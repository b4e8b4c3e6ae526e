"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from plumbline.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v if isinstance(v, bool) else str(v)


def rows(cols, data):
    order = sorted(cols)
    return sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    want = c.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name, parts", [("whole_checks", None), ("fuzzy_rows", 13), ("range_sums", 13), ("missing_rows", 13), ("identity_verdicts", 13)])
def test_partitions_grow_with_the_rows(spark, name, parts, monkeypatch):
    """What a task sorts and groups by table mustn't grow with the input, nor a frequent label gather it."""
    from plumbline.operators import joins

    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    monkeypatch.setattr(joins, "DEALT", -(-lines // 13))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = registry.QUERIES[name](spark, DIR)
        assert parts is None or got.rdd.getNumPartitions() == parts
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count(", 13)") >= 1 and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    test_matches_sql(spark, name)


def test_segments_against_a_loop(spark):
    from plumbline.operators import statements
    from plumbline.plans.statements import _pages

    pages = _pages(spark, DIR)
    want = []
    by = {}
    for r in pages.collect():
        by.setdefault(r.o_custkey, []).append(r)
    for key, own in by.items():
        parts = []
        for p in sorted(own, key=lambda r: (r.page, r.width, r.strong, r.rows)):
            s = parts[-1] if parts else None
            if s is None or p.page != s["last"] + 1 or s["n"] >= 8 or (p.width > 0 and s["width"] > 0 and p.width != s["width"]) or set(p.strong) & s["seen"]:
                parts.append({"first": p.page, "last": p.page, "n": 1, "width": p.width, "seen": set(p.strong)})
            else:
                s.update(last=p.page, n=s["n"] + 1, width=s["width"] or p.width, seen=s["seen"] | set(p.strong))
        want += [(key, k, s["first"], s["last"], s["n"]) for k, s in enumerate(parts)]
    got = statements.segments(pages, ["o_custkey"], 8).select("o_custkey", "segment", "first_page", "last_page", "pages").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_output_is_an_error(spark):
    from plumbline.sources.writers import EmptyResult, non_empty

    with pytest.raises(EmptyResult):
        non_empty(spark.range(0), "result")
