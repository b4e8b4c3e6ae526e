"""Readers and writers on small files of the formats they are made for."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import statements as S
from plumbline.sources import readers as R
from plumbline.sources import writers as W


def put(path, text, bom=False):
    path.write_text(("﻿" if bom else "") + text, encoding="utf-8")
    return str(path)


def test_daily_bars(spark, tmp_path):
    a = put(tmp_path / "a.csv", "日期,股票代码,开盘,收盘,最高,最低,成交量,成交额,振幅,涨跌幅,涨跌额,换手率\n2024-01-02,600000,10.0,10.5,11,9.9,1200,12600.0,1.1,5.0,0.5,0.2\n", bom=True)
    b = put(tmp_path / "b.csv", "date,open,high,low,close,volume,amount,outstanding_share,turnover\n2024-01-02,10.0,11,9.9,10.5,1200.0,12600.0,1e9,0.2\n")
    for path, vendor in ((a, "a"), (b, "b")):
        r = R.daily_bars(spark, path, vendor).select("date", "close").first()
        assert tuple(r) == (datetime.date(2024, 1, 2), 10.5)
    assert R.daily_bars(spark, a).first()["code"] == "600000"


def test_announcements_with_a_bad_stamp(spark, tmp_path):
    path = put(tmp_path / "x.csv", "代码,简称,公告标题,公告时间,公告链接\n600000,甲,2023年年度报告,2024-04-01 00:00:00,http://x?announcementId=12\n600000,甲,2024年半年度报告,bad,http://x\n")
    got = {r.title: r.announced for r in R.announcements(spark, path).collect()}
    assert got == {"2023年年度报告": datetime.date(2024, 4, 1), "2024年半年度报告": None}
    assert R.resolve(R.announcements(spark, path), "annou", "title") == "announced"
    with pytest.raises(ValueError):
        R.resolve(R.announcements(spark, path), "nothing")


def test_corpus_and_manifest(spark, tmp_path):
    put(tmp_path / "one.txt", "第一行\n第二行")
    m = put(tmp_path / "m.json", json.dumps([{"file": "one.txt", "announced": "2024-01-02", "title": "t"}, {"file": "two.txt", "announced": None, "title": "u"}], ensure_ascii=False))
    docs = R.corpus(spark, str(tmp_path / "*.txt"))
    assert [tuple(r) for r in docs.collect()] == [("one.txt", "第一行\n第二行")]
    found = docs.join(R.manifest(spark, m).withColumnRenamed("file", "doc"), "doc").first()
    assert found.announced == "2024-01-02"


TABLE = {"label": "BS", "scope": "合并", "pages": [3, 4], "header": ["项目", "2023年12月31日", "2022年12月31日"], "unit": "元", "table": "资产负债表", "period": "2023FY", "announced": "2024-04-01", "source": "x.pdf", "title": "t", "symbol": "600000", "short": "甲", "kind": "bank"}


def test_statement_tables(spark, tmp_path):
    rows = [{"label": "货币资金", "vals": [1.5, None]}, {"label": "资产总计", "vals": [2.5, 3.5]}]
    for name, more in (("b", {}), ("a", {}), ("c", {"rows": rows[:1]}), ("d", {"scope": "母公司", "rows": rows * 3})):
        put(tmp_path / f"{name}.json", json.dumps({**TABLE, "rows": rows, **more}, ensure_ascii=False, indent=1))
    tables = R.statement_tables(spark, str(tmp_path))
    best = R.longest_consolidated(tables)
    assert [r.file for r in best.collect()] == ["a.json"]
    lines = R.statement_lines(best).orderBy("row_idx", "col_idx").collect()
    assert [(r.label_raw, r.col_idx, r.value, r.header_text) for r in lines] == [("货币资金", 0, 1.5, "2023年12月31日"), ("货币资金", 1, None, "2022年12月31日"), ("资产总计", 0, 2.5, "2023年12月31日"), ("资产总计", 1, 3.5, "2022年12月31日")]


def test_concepts(spark, tmp_path):
    path = put(tmp_path / "c.json", json.dumps({"_note": "text", "BS": {"资产总计": ["资产合计", "总资产"], "负债合计": []}, "IS": {"净利润": []}, "CF": {}}, ensure_ascii=False))
    got = R.concepts(spark, path).orderBy("stmt", "ord").select("stmt", "concept", "alias").collect()
    assert [tuple(r) for r in got] == [("BS", "资产总计", "资产总计"), ("BS", "资产总计", "资产合计"), ("BS", "资产总计", "总资产"), ("BS", "负债合计", "负债合计"), ("IS", "净利润", "净利润")]


def test_logs(spark):
    lines = [("f", 1, "warn p1"), ("f", 2, "warn p2"), ("f", 3, "done 甲"), ("f", 4, "warn p3"), ("g", 1, "done 乙"), ("g", 2, "warn p4"), ("g", 3, "done 丙")]
    df = spark.createDataFrame(lines, "file string, n int, text string")
    got = R.attributed_log(df, "n", "text", r"done (.+)", r"warn (p\d)", "file").orderBy("file", "n").collect()
    assert [(r.text, r.owner) for r in got] == [("warn p1", "甲"), ("warn p2", "甲"), ("warn p4", "丙")]


def test_valid_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" + b"x" * 100)
    (tmp_path / "b.pdf").write_bytes(b"<html" + b"x" * 100)
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = R.valid_files(files, least=50).select("path", W.fingerprint(F.col("content")).alias("f")).collect()
    assert [r.path[-5:] for r in got] == ["a.pdf"] and len(got[0].f) == 12


def test_constituents_and_sources(spark):
    none, some, last = (spark.createDataFrame(x, "code string, name string") for x in ([], [("1", "b"), ("1", "a"), ("2", "c")], [("9", "z")]))
    assert sorted(map(tuple, R.constituents([none, some], last).collect())) == [("1", 1, "a"), ("2", 1, "c")]
    assert sorted(map(tuple, R.constituents([none], last).collect())) == [("9", 1, "z")]
    vendors = spark.createDataFrame([("k", "b", 1), ("k", "cache", 2), ("j", "b", 3)], "key string, source string, v int")
    rank = F.array_position(F.array(F.lit("cache"), F.lit("a"), F.lit("b")), F.col("source"))
    assert sorted((r.key, r.source) for r in R.first_source(vendors, ["key"], rank).collect()) == [("j", "b"), ("k", "cache")]


def test_partitioned_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    wanted = spark.createDataFrame([("600000", "qfq"), ("000001", "qfq")], "symbol string, adj string")
    held, rest = R.cached(spark, path, wanted, ["symbol", "adj"])
    assert held is None and rest.count() == 2
    bars = spark.createDataFrame([("600000", "qfq", 1.0), ("600000", "hfq", 2.0)], "symbol string, adj string, close double")
    W.partitions(bars, path, ["symbol", "adj"])
    W.partitions(bars.where("adj = 'qfq'").withColumn("close", F.lit(3.0)), path, ["symbol", "adj"])
    held, rest = R.cached(spark, path, wanted, ["symbol", "adj"])
    assert [(r.symbol, r.close) for r in held.collect()] == [("600000", 3.0)] and [r.symbol for r in rest.collect()] == ["000001"]
    assert spark.read.parquet(path).count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("甲", 1.5), ("乙", None)], "name string, x double").coalesce(1)
    W.csv(df, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfname,x\n") and spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["name", "x"]
    W.json(df, str(tmp_path / "j"))
    assert sorted(json.loads(x)["x"] or 0 for x in next((tmp_path / "j").glob("part*")).read_text().splitlines()) == [0, 1.5]
    W.document(df, str(tmp_path / "d"))
    whole = next((tmp_path / "d").glob("part*")).read_text()
    assert json.loads(whole) == [{"name": "甲", "x": 1.5}, {"name": "乙", "x": None}] and whole.count("\n") > 4
    for _ in range(2):
        W.append_runs(df, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 4
    W.per_entity(df, str(tmp_path / "e"), ["name"])
    assert sorted(p.name for p in (tmp_path / "e").glob("name=*")) == ["name=乙", "name=甲"]
    assert W.markdown(df) == "| name | x |\n| --- | --- |\n| 甲 | 1.5 |\n| 乙 |  |"
    with pytest.raises(ValueError):
        W.markdown(df, most=1)
    with pytest.raises(W.EmptyResult):
        W.csv(df.limit(0), str(tmp_path / "n"))
    # a missing input is an error, too
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        R.statement_tables(spark, str(tmp_path / "nowhere")).count()


def test_a_table_without_any_term_is_skipped(spark):
    lines = spark.createDataFrame([(1, "a", 0, 3.0), (1, "b", 0, 3.0), (2, "other", 0, 1.0), (3, "a", 0, 1.0), (3, "b", 0, None), (4, "a", 0, 1.0), (4, "b", 0, 2.0)], "t int, concept string, col_idx int, value double")
    terms = spark.createDataFrame([("a = b", "a", -1, False), ("a = b", "b", 1, False)], "ident string, concept string, coef int, optional boolean")
    got = {r.t: (r.verdict, r.detail) for r in S.explained(S.identity_residuals(lines, terms, ["t"]), ["t"]).collect()}
    assert got == {1: ("pass", "residual 0.00"), 2: ("skip", "missing a, b"), 3: ("skip", "missing b"), 4: ("fail", "residual 1.00")}
