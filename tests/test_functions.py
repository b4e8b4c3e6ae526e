"""Golden cases of column functions."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_labels(spark):
    lit = F.lit
    assert one(spark, T.label(lit('五、净利润（净亏损以"-"号填列）'))) == "净利润"
    assert one(spark, T.label(lit("其中：归属于母公司股东的净利润"))) == "归属于母公司股东的净利润"
    assert one(spark, T.label(lit("12、存货："), digits=True)) == "存货"
    assert one(spark, T.label(lit("12、存货："))) == "12、存货"
    assert one(spark, T.label(lit("加:其他"), ascii_colon=True)) == "其他"


@pytest.mark.parametrize("cell,want", [("1,234.50", 1234.5), ("(12)", -12.0), ("—", None), ("", None), ("不适用", None), ("12a", None), ("-3", -3.0), (None, None)])
def test_numbers(spark, cell, want):
    assert one(spark, T.to_number(F.lit(cell).cast("string"))) == want


def test_periods(spark):
    for title, want in (("2024年半年度报告", "2024H1"), ("2023年年度报告", "2023FY"), ("2024年第三季度报告", "2024Q3"), ("公告", "")):
        assert one(spark, T.period_of(F.lit(title))) == want


def test_units(spark):
    assert one(spark, T.unit(F.lit("金额单位为人民币百万元"))) == "百万元"
    assert one(spark, T.in_base_unit(F.lit(1.0), F.lit("百万元")))["value"] == 1e6
    unknown = one(spark, T.in_base_unit(F.lit(7.0), F.lit(None).cast("string")))
    assert (unknown["value"], unknown["unit"]) == (7.0, "?")


def test_citations_and_variants(spark):
    assert one(spark, T.citations(F.lit("a[片段 2]b[片段3·补]c[片段4]"))) == [2, 4]
    assert one(spark, T.citations(F.lit("a[片段 2]c[片段4]"), tight=True)) == [4]
    assert "120,776,000,000.0" in one(spark, T.variants(F.lit("1207.76")))
    assert one(spark, T.numbers(F.lit("2024年 1,234.5 与 88"), without_years=True)) == ["1,234.5", "88"]
    fixed = one(spark, T.repaired(F.lit("收入为12.5亿元。没有数字。"), F.array(F.lit("x"), F.lit("收入 1,250,000,000.00 元"))))
    assert fixed == "收入为12.5亿元。[片段2·补]没有数字。"


def test_headers(spark):
    header = F.array(*map(F.lit, ("项目", "附注", "2023年12月31日", "2022年12月31日")))
    assert one(spark, A.column_for_period(header, F.lit("2022FY"))) == 1
    assert one(spark, A.column_for_period(F.array(*map(F.lit, ("", "珠海", "格力电器股份有限公司2023年年度", "报告全文", ""))), F.lit("2023FY"))) == 0
    assert one(spark, T.is_runner(F.array(F.lit("格力电器股份有限公司2023年年度报告"))))
    assert not one(spark, T.is_runner(F.array(F.lit("有限公司"), F.lit("1,234,567"))))
    assert one(spark, A.value_at(F.array(F.lit(1.0)), F.lit(3))) is None
    assert one(spark, T.is_heading(F.lit("1、合并资产负债表（续）"), "合并资产负债表"))
    assert not one(spark, T.is_heading(F.lit("3.3 资产负债表分析"), "资产负债表"))


def test_bigrams(spark):
    assert sorted(one(spark, T.bigrams(F.lit("ab ab")))) == ["ab", "ba"]
    assert one(spark, T.bigrams(F.lit("a"))) == []


@pytest.mark.parametrize("line,name,want", [("资产负债表项目", "资产负债表", False), ("（一）合并利润表", "合并利润表", True), ("合并利润表（续）", "合并利润表", True), ("12、利润表", "利润表", True), ("利润表日", "利润表", False), ("二、现金流量表主要", "现金流量表", False), ("包括合并利润表", "合并利润表", False), (None, "利润表", False)])
def test_heading_rule(spark, line, name, want):
    assert one(spark, T.is_heading(F.lit(line).cast("string"), name)) == want


def test_headings_by_rank(spark):
    for line, want in (("母公司现金流量表", ("CF", "母公司")), ("合并资产负债表", ("BS", "合并")), ("利润表", ("IS", "母公司")), ("本公司利润表（续）", ("IS", "母公司"))):
        assert tuple(one(spark, T.heading(F.lit(line)))) == want
    assert one(spark, T.heading(F.lit("目录"))) is None
    assert one(spark, T.most_specific(F.lit("合并资产负债表"), ("资产负债表", "合并资产负债表"))) == "合并资产负债表"


def test_words_and_titles(spark):
    lit = F.lit
    assert one(spark, T.compact(lit("1, 2，3　x"))) == "123x" and one(spark, T.squeezed(lit("a \t b,c"))) == "a b,c" and one(spark, T.squeezed(lit("a \t b,c"), "")) == "abc"
    assert one(spark, T.abstains(lit("资料中未包含该信息"))) and not one(spark, T.abstains(lit("尚未披露"))) and one(spark, T.abstains(lit("尚未披露"), as_of=True))
    assert one(spark, T.sentences(lit("一。二；\n三 "))) == ["一。", "二；", "\n三 "]
    assert one(spark, T.forced_numbers(lit("a 12 b 1,234.5 c 999"))) == ["1,234.5", "999"]
    assert one(spark, T.hits(lit("净利润与营业收入"), ["净利润", "营业收入", "现金"])) == 2
    assert one(spark, T.contains_any(lit("abc"), ["x", "b"])) and one(spark, T.contains_none(lit("abc"), ["x", "y"])) and not one(spark, T.contains_none(lit("abc"), ["a"]))
    assert one(spark, T.is_report(lit("甲公司2023年年度报告"))) and not one(spark, T.is_report(lit("甲公司2023年年度报告摘要")))
    assert one(spark, T.is_report(lit("2023年度报告"), company=True)) and not one(spark, T.is_report(lit("关于2023年年度报告"), company=True))
    assert one(spark, T.stripped_title(lit("甲公司：2023年 年度报告"), lit("甲公司"))) == "2023年年度报告"
    assert one(spark, T.announcement_id(lit("http://x/y?announcementId=123&z=1"))) == "123" and one(spark, T.six_digits(lit("sh600519.csv"))) == "600519"
    assert one(spark, T.exchange_symbol(lit("600519"))) == "sh600519" and one(spark, T.exchange_symbol(lit("000002"))) == "sz000002"
    assert one(spark, T.company_period(lit("2023年年度报告"))) == "2023FY" and one(spark, T.first_match(lit("x半年y"), [("半年", "06-30"), ("年", "12-31")])) == "06-30"


def test_amounts_and_nested(spark):
    assert one(spark, T.amount(F.lit(1234.5))) == "1,234.50" and one(spark, T.amount(F.lit(1234.5), 0)) in ("1,234", "1,235") and one(spark, T.percentage(F.lit(0.1234))) == "12.34%"
    assert one(spark, T.amount(F.lit(None).cast("double"))) is None
    assert one(spark, T.nested(F.lit('{"a": {"b": 3}}'), "a.b", F.lit("0"))) == "3" and one(spark, T.nested(F.lit("no"), "a.b", F.lit("0"))) == "0"
    assert one(spark, T.found_in(F.lit("共 1,207.76 亿"), F.lit("1207.76"))) and not one(spark, T.found_in(F.lit("共 1,207.7"), F.lit("1207.76")))
    assert one(spark, T.unresolved(F.lit("收入 77。其他。数 88[片段1]。"), F.array(F.lit("无")))) == ["收入 77。"]
    block = one(spark, T.fragment_block(F.array(F.lit("ab")), F.array(F.lit("x.txt")), F.array(F.lit(5))))
    assert block == "[片段1]（来源 x.txt 字符 5–7）\nab"
    assert one(spark, T.is_header(F.array(F.lit("项目"), F.lit("x")))) and one(spark, T.is_header(F.array(F.lit("a"), F.lit("2023年")))) and not one(spark, T.is_header(F.array(F.lit("a"), F.lit("b"))))


def test_arrays(spark):
    v = F.array(F.lit(None).cast("double"), F.lit(2.0), F.lit(3.0))
    assert one(spark, A.first_value(v)) == 2.0 and one(spark, A.chosen(v, F.array(F.lit(2), F.lit(0), F.lit(9)))) == [3.0, None, None]
    assert one(spark, A.scaled(v, 10)) == [None, 20.0, 30.0] and one(spark, F.reverse(v)) == [3.0, 2.0, None]
    header = F.array(*map(F.lit, ("项目", "2023年 12月31日", "2022年12月31日")))
    assert one(spark, A.column_of(header, F.lit("2022年12月31日"))) == 1 and one(spark, A.column_of(header, F.lit("2023年12月31日"))) == 0 and one(spark, A.column_of(header, F.lit("2021"))) is None
    assert one(spark, A.close(F.lit(1e9), F.lit(1e9 + 500))) and not one(spark, A.close(F.lit(5.0), F.lit(7.0)))
