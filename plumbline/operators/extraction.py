"""From cells of pages to statements with metadata, in one plan.

What comes in is what a parser sees: lines of text by page, and tables by page,
strategy and version (cropped or whole), each as nested cells. A page's best
candidate gets its statement and scope from the nearest heading above it, else
from the last heading so far; its unit and header from the pages before, where
it has none. One fold over a document's pages joins them to segments; how far
two parse paths agree goes along, so that a segment on which they mostly
disagree isn't adopted. Everything is dealt by document, whose pages one task
holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.arrays import let
from plumbline.operators import joins, segmenting
from plumbline.operators import statements as S

# Words that a statement's own tables hold, words of other tables, and labels that a statement has once.
SIGNATURES = {
    "BS": ["货币资金", "应收账款", "存货", "流动资产合计", "非流动资产合计", "资产总计", "负债合计", "所有者权益合计", "负债和所有者权益总计", "未分配利润", "实收资本", "现金及存放中央银行款项", "存放同业款项", "拆出资金", "发放贷款和垫款", "买入返售金融资产", "金融投资", "吸收存款", "向中央银行借款", "同业及其他金融机构存放款项", "拆入资金", "卖出回购金融资产款", "股东权益合计", "负债及股东权益总计", "归属于本行股东权益"],
    "IS": ["营业总收入", "营业收入", "营业总成本", "税金及附加", "销售费用", "管理费用", "营业利润", "利润总额", "所得税费用", "净利润", "少数股东损益", "基本每股收益", "利息净收入", "利息收入", "利息支出", "手续费及佣金净收入", "业务及管理费", "信用减值损失", "归属于本行股东的净利润"],
    "CF": ["经营活动产生的现金流量", "投资活动产生的现金流量", "筹资活动产生的现金流量", "现金及现金等价物净增加额", "期末现金及现金等价物余额", "期初现金及现金等价物余额", "向中央银行借款净增加额", "客户存款和同业存放款项净增加额", "发放贷款和垫款净增加额"],
}
NOISE = ["分部报告", "分部信息", "附注", "关联交易", "会计政策", "增减变动", "补充资料", "上年年末余额", "本年期初余额", "主要业务", "经营分析", "分解信息", "说明"]
STRONG = {"BS": ["货币资金", "资产总计"], "IS": ["营业总收入", "净利润"], "CF": ["经营活动产生的现金流量净额", "期末现金及现金等价物余额"]}
SCORED_ROWS, PATH_ROWS, MOST_PAGES = 60, 5, 8  # rows that are scored, rows of a table that a parse path counts with, pages of a segment
COMPARED, AGREED = 5, 0.8  # labels in common from which two parse paths are compared, and how many of them agree at least
TABLE = ["cropped", "strategy", "table_no", "top", "cells"]
PAGE = ["doc", "page"]


def body(rows: Column) -> Column:
    """Rows of cells without the leading ones that are page headers."""

    def of(all_: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("body"))
        step = lambda s, r: F.when(s["body"], s).otherwise(let(F.coalesce(~T.is_runner(r), F.lit(False)), lambda own: F.struct((s["n"] + (~own).cast("int")).alias("n"), own.alias("body"))))
        cut = let(F.aggregate(all_, zero, step)["n"], lambda n: F.slice(all_, n + 1, F.size(all_)))
        return F.when((F.size(all_) > 0) & ~T.is_runner(F.get(all_, F.lit(0))), all_).otherwise(cut)

    return let(rows, of)


def tidy(cells: Column) -> Column:
    """Cells of a row with blanks for line ends, trimmed; missing ones empty."""
    return F.transform(cells, lambda c: F.btrim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))


def cleaned(rows: Column) -> Column:
    """Rows of cells as labels and values, without blank rows and the row of items."""
    item = lambda c: c.contains("项") & (T.label(c, prefixes=False) == "项目")  # noqa: E731  a label is made for few
    full = F.filter(F.transform(rows, tidy), lambda r: F.exists(r, lambda c: c != "") & ~F.coalesce(item(F.get(r, F.lit(0))), F.lit(False)))
    return F.transform(full, lambda r: F.struct(F.get(r, F.lit(0)).alias("label"), F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), T.to_number).alias("vals")))


def _columns(rows: Column) -> Column:
    """For each place the values there are, (place, values)."""
    w = segmenting.width(F.transform(rows, lambda r: r["vals"]))
    places = let(w, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    return F.transform(places, lambda j: F.struct(j.alias("j"), F.filter(F.transform(rows, lambda r: F.get(r["vals"], j)), lambda v: v.isNotNull()).alias("v")))


def _at(rows: Column, keep: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r["label"].alias("label"), F.transform(keep, lambda c: F.get(r["vals"], c["j"])).alias("vals")))


def _enough(values: Column, rows: Column) -> Column:
    return F.size(values) >= F.greatest(F.lit(S.LEAST).cast("double"), S.SHARE * F.size(rows))


def without_notes(rows: Column) -> Column:
    """rows without empty columns and those of note numbers, which are small and whole in enough rows."""

    def of(r: Column) -> Column:
        small = lambda v: F.forall(v, lambda x: (F.abs(x) < S.SMALL) & (x == F.floor(x)))
        keep = F.filter(_columns(r), lambda c: (F.size(c["v"]) > 0) & ~(small(c["v"]) & _enough(c["v"], r)))
        return let(keep, lambda k: F.when(F.size(k) > 0, _at(r, k)).otherwise(r))

    return let(rows, of)


def aligned(header: Column, rows: Column) -> Column:
    """Struct of header, rows and dropped of a segment: columns whose header says
    notes go, and those that most rows leave empty; header and values stay together."""
    note = lambda j: T.label(F.coalesce(F.get(header, j + 1), F.lit("")), prefixes=False) == "附注"

    def of(columns: Column) -> Column:
        good = F.filter(columns, lambda c: ~note(c["j"]) & _enough(c["v"], rows))
        return let(F.when(F.size(good) > 0, good).otherwise(F.filter(columns, lambda c: F.size(c["v"]) > 0)), lambda keep: result(columns, keep))

    def result(columns: Column, keep: Column) -> Column:
        dropped = F.size(columns) - F.size(keep)
        named = F.concat(F.array(F.coalesce(F.get(header, F.lit(0)), F.lit("项目"))), F.transform(keep, lambda c: F.coalesce(F.get(header, c["j"] + 1), F.lit(""))))
        return F.struct(F.when(dropped > 0, named).otherwise(header).alias("header"), F.when(dropped > 0, _at(rows, keep)).otherwise(rows).alias("rows"), dropped.alias("dropped"))

    return let(_columns(rows), of)


def once(value: Column) -> Column:
    """The fields of a struct as columns. As they are generated, filters on them aren't
    moved below, where their expressions would be worked out again for each mention."""
    return F.inline(F.array(value))


def headings(lines: Column) -> Column:
    """The headings among lines (y, text), in order of height."""
    may = F.filter(lines, lambda x: T.contains_any(x["text"], sorted({name[-1] for name, _, _ in T.HEADINGS})))
    found = F.transform(may, lambda x: let(T.heading(x["text"]), lambda h: F.struct(x["y"].alias("y"), h["label"].alias("label"), h["scope"].alias("scope"))))
    return F.array_sort(F.filter(found, lambda h: h["label"].isNotNull()))


def read(tables: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(candidates, texts): the candidates of a page, (cropped, strategy,
    table_no, top, at, score, rows), with the place of their text, the score and
    the number of rows; and the texts, (cells, score, rows), each once: cells
    without page headers. Tables that say the same are read once."""

    def score(cells: Column) -> Column:
        # the words have no blanks and none of ASCII, so they lie within one cell, and within one that isn't ASCII alone
        own = F.flatten(F.filter(F.slice(cells, 1, SCORED_ROWS), lambda r: r.isNotNull()))
        flat = F.array_join(F.array_distinct(F.filter(own, lambda c: F.octet_length(c) > F.char_length(c))), " ")
        return S.candidate_score(flat, SIGNATURES, NOISE, F.array_join(F.get(cells, F.lit(0)), " ").rlike("(?:19|20)[0-9]{2}"))

    def placed(bodies: Column, texts: Column) -> Column:
        each = F.arrays_zip(tables.alias("t"), bodies.alias("b"))
        at = lambda x: F.array_position(texts["cells"], x["b"]).cast("int") - 1
        of = lambda x, i: F.struct(x["t"]["cropped"].alias("cropped"), x["t"]["strategy"].alias("strategy"), x["t"]["table_no"].alias("table_no"), x["t"]["top"].alias("top"), i.alias("at"), F.get(texts, i)["score"].alias("score"), F.size(F.get(texts, i)["rows"]).alias("rows"))
        return F.transform(each, lambda x: let(at(x), lambda i: of(x, i)))

    def of(bodies: Column) -> Column:
        texts = F.transform(F.filter(F.array_distinct(bodies), lambda c: F.size(c) > 0), lambda c: F.struct(c.alias("cells"), score(c).alias("score"), without_notes(cleaned(c)).alias("rows")))
        return let(texts, lambda x: let(placed(bodies, x), lambda c: then(c, x)))

    return let(F.transform(tables, lambda t: body(t["cells"])), of)


def best(found: Column) -> Column:
    """The best of candidates: strategies are tried up to the first that is good
    enough; the cropped page wins over the whole one where it is no worse."""
    good = F.filter(found, lambda c: c["score"] >= S.MIN_SCORE)

    def version(all_: Column, cropped: bool | None) -> Column:
        own = F.filter(all_, lambda c: c["cropped"].eqNullSafe(F.lit(cropped).cast("boolean")))
        stop = lambda o: F.array_min(F.transform(F.filter(o, lambda c: c["score"] >= S.ENOUGH), lambda c: c["strategy"]))
        tried = let(own, lambda o: let(stop(o), lambda s: F.filter(o, lambda c: s.isNull() | (c["strategy"] <= s))))
        return F.array_min(F.transform(tried, lambda c: F.struct((-c["score"]).alias("score"), c["top"].alias("top"), c["strategy"].alias("strategy"), c["table_no"].alias("table_no"), c["at"].alias("at"))))

    def of(all_: Column) -> Column:
        each = F.filter(F.array(*[F.struct(version(all_, c).alias("c"), F.lit(n).alias("n")) for n, c in enumerate((True, False, None))]), lambda v: v["c"].isNotNull())
        return F.array_min(F.transform(each, lambda v: F.struct(v["c"]["score"].alias("score"), v["n"].alias("n"), v["c"].alias("c"))))["c"]

    return let(good, of)


def disputed(found: Column, texts: Column) -> Column:
    """Whether two parse paths, each by its longest table, have five labels or
    more in common and mostly differ in their first values."""

    def path(strategy: int) -> Column:
        own = F.filter(found, lambda c: ~c["cropped"] & (c["strategy"] == strategy) & (c["rows"] >= PATH_ROWS))
        longest = F.array_min(F.transform(own, lambda c: F.struct((-c["rows"]).alias("n"), c["table_no"].alias("table_no"), c["at"].alias("at"))))["at"]
        value = lambda r: F.get(F.filter(r["vals"], lambda v: v.isNotNull()), F.lit(0))
        facts = F.transform(F.get(texts, longest)["rows"], lambda r, i: F.struct(T.label(r["label"], digits=True, prefixes=False).alias("label"), F.lit(strategy).alias("side"), i.alias("i"), value(r).alias("value")))
        return F.filter(F.coalesce(facts, F.array().cast("array<struct<label string, side int, i int, value double>>")), lambda x: (x["label"] != "") & x["value"].isNotNull())

    def before(all_: Column, i: Column, field: str) -> Column:
        return F.get(all_, i - 1)[field]

    def compared(all_: Column) -> Column:  # a label's first of each path, in order: both stand side by side
        same = lambda x, i: F.abs(before(all_, i, "value") - x["value"]) <= F.greatest(F.lit(1.0), 1e-6 * F.abs(before(all_, i, "value")))
        met = F.transform(all_, lambda x, i: F.when(before(all_, i, "label") == x["label"], same(x, i)))
        return let(F.filter(met, lambda x: x.isNotNull()), lambda m: (F.size(m) >= COMPARED) & (F.size(F.filter(m, lambda x: x)) / F.size(m) < AGREED))

    first = lambda all_: F.filter(all_, lambda x, i: ~F.coalesce((before(all_, i, "label") == x["label"]) & (before(all_, i, "side") == x["side"]), F.lit(False)))
    return let(let(F.array_sort(F.concat(path(0), path(1))), first), compared)


def paged(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, page, lines, tables): what each page with text holds, as arrays. lines: (doc, page, y,
    text), tables: (doc, page, cropped, strategy, table_no, top, cells)."""
    text = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "text"))).alias("lines"))
    return text.join(tables.groupBy(*PAGE).agg(F.collect_list(F.struct(*TABLE)).alias("tables")), PAGE, "left")


def chosen(tables: DataFrame) -> DataFrame:
    """(doc, page, top, cells): each page's best candidate. tables: as for ``paged``."""
    own = tables.groupBy(*PAGE).agg(F.collect_list(F.struct(*TABLE)).alias("tables"))
    pick = lambda found, texts: let(best(found), lambda b: F.struct(b["top"].alias("top"), F.get(texts, b["at"])["cells"].alias("cells")))
    return own.select(*PAGE, once(read(F.col("tables"), pick))).where("cells is not null")


def parts(pages: DataFrame) -> DataFrame:
    """(doc, page, label, scope, header, rows, unit, strong, bad): the page's
    part of a statement, where it passes the gate of its kind. pages: as from
    ``paged``. Each page is read by itself; only what it says goes on to those after it."""
    words = sorted({w for some in STRONG.values() for w in some})
    first = F.array_min(F.transform(F.filter("tables", lambda t: ~t["cropped"] & (t["strategy"] == 0) & t["table_no"].isNotNull()), lambda t: F.struct(t["table_no"].alias("n"), F.get(t["cells"], F.lit(0)).alias("header"))))["header"]
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")

    def said(found: Column, texts: Column) -> Column:
        names = lambda rows: F.array_intersect(F.transform(rows, lambda r: T.label(r["label"], prefixes=False)), F.array(*map(F.lit, words)))
        part = lambda b, t: F.struct(b["top"].alias("top"), tidy(F.get(t["cells"], F.lit(0))).alias("own"), segmenting.gates(t["cells"]).alias("kinds"), t["rows"].alias("rows"), names(t["rows"]).alias("strong"))
        return let(best(found), lambda b: F.struct(F.when(b.isNotNull(), part(b, F.get(texts, b["at"]))).alias("part"), disputed(found, texts).alias("bad")))

    known = pages.select(*PAGE, once(F.struct(headings(F.col("lines")).alias("headings"), T.unit(text).alias("_unit"), first.alias("own_header"), read(F.col("tables"), said).alias("_t"))))
    base = known.select(*PAGE, "headings", "_unit", "own_header", "_t.part", "_t.bad")

    w = Window.partitionBy("doc").orderBy("page")
    last = F.get("headings", F.size("headings") - 1)
    anchor = F.last(F.when(F.size("headings") > 0, F.struct(last["label"].alias("label"), last["scope"].alias("scope"))), ignorenulls=True).over(w)
    near = lambda c, k: F.when(F.lag("page", k).over(w) == F.col("page") - k, F.lag(c, k).over(w))
    # of the two pages before, each is looked up by its number
    before = lambda n: F.coalesce(*[F.when(F.lag("page", k).over(w) == F.col("page") - n, F.lag("_unit", k).over(w)) for k in range(1, n + 1)])
    base = base.withColumns({"anchor": anchor, "unit": F.coalesce("_unit", before(1), before(2)), "header_before": near("own_header", 1)})

    above = F.filter("headings", lambda h: h["y"] <= F.col("part.top") + 2)
    place = let(above, lambda a: F.when(F.size(a) > 0, F.struct(F.get(a, F.size(a) - 1)["label"].alias("label"), F.get(a, F.size(a) - 1)["scope"].alias("scope"))).otherwise(F.col("anchor")))
    heads = lambda cells: F.coalesce(T.is_header(cells), F.lit(False))
    own = F.col("part.own")
    header = F.when(heads(own), own).when(heads(tidy(F.col("own_header"))), tidy(F.col("own_header"))).when(heads(tidy(F.col("header_before"))), tidy(F.col("header_before"))).otherwise(own)
    found = base.where("part is not null and anchor is not null").select(*PAGE, once(place), header.alias("header"), "part", "unit", "bad").where(F.array_contains("part.kinds", F.col("label")))
    strong = F.create_map(*[x for kind, some in STRONG.items() for x in (F.lit(kind), F.array(*map(F.lit, some)))])
    return found.select(*PAGE, "label", "scope", "header", "part.rows", "unit", F.array_intersect("part.strong", F.element_at(strong, F.col("label"))).alias("strong"), F.coalesce("bad", F.lit(False)).alias("bad"))


KEY = ["doc", "label", "scope"]


def runs(parts: DataFrame) -> DataFrame:
    """(doc, label, scope, segment, _p): the parts of each segment in order of
    pages. Pages that don't follow each other are of different segments; over
    those that do goes one fold, whose state is what the open segment holds so far."""
    w = Window.partitionBy(*KEY).orderBy("page")
    item = F.struct("page", "header", "rows", "unit", "strong", "bad")
    state = "struct<n int, width int, seen array<string>, starts array<int>>"

    def add(s: Column, p: Column, i: Column) -> Column:
        wide = segmenting.width(F.transform(p["rows"], lambda r: r["vals"]))

        def with_width(width: Column) -> Column:
            fresh = (s["n"] == 0) | (s["n"] >= MOST_PAGES) | ((width > 0) & (s["width"] > 0) & (width != s["width"])) | F.arrays_overlap(p["strong"], s["seen"])
            return let(F.coalesce(fresh, F.lit(True)), lambda f: grown(width, f))

        def grown(width: Column, fresh: Column) -> Column:
            return F.struct(
                F.when(fresh, 1).otherwise(s["n"] + 1).alias("n"), F.when(fresh | (s["width"] == 0), width).otherwise(s["width"]).alias("width"),
                F.when(fresh, p["strong"]).otherwise(F.array_union(s["seen"], p["strong"])).alias("seen"), F.when(fresh, F.concat(s["starts"], F.array(i))).otherwise(s["starts"]).alias("starts"),
            ).cast(state)

        return let(wide, with_width)

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("width"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("starts")).cast(state)
    run = parts.withColumn("_run", F.col("page") - F.row_number().over(w)).groupBy(*KEY, "_run").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    starts = F.aggregate(F.transform("_all", lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i"))), zero, lambda s, x: add(s, x["p"], x["i"]))["starts"]
    cut = let(starts, lambda at: F.transform(at, lambda a, k: F.slice("_all", a, F.coalesce(F.get(at, k + 1), F.size("_all") + 1) - a)))
    return run.select(*KEY, F.explode(cut).alias("_p")).select(*KEY, F.get("_p", F.lit(0))["page"].alias("segment"), "_p")


def segments(lines: DataFrame, tables: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc, label, scope, copy, pages, header, rows, unit, dropped, and the
    manifest's columns): the statements of each document. lines: (doc, page, y,
    text), tables: (doc, page, cropped, strategy, table_no, top, cells), manifest: one row a doc."""
    return of_pages(paged(lines.repartition("doc"), tables.repartition("doc")), manifest)  # all later keys begin with it


def of_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``segments`` of pages as from ``paged``. Where they are dealt by document,
    nothing is shuffled, and of a page only what it says is sorted, not its tables."""
    joined = runs(parts(pages)).select(
        *KEY, "segment", F.transform("_p", lambda p: p["page"]).alias("pages"), F.get("_p", F.lit(0))["header"].alias("header"), F.flatten(F.transform("_p", lambda p: p["rows"])).alias("rows"),
        F.get(F.filter(F.transform("_p", lambda p: p["unit"]), lambda u: u.isNotNull()), F.lit(0)).alias("unit"), F.exists("_p", lambda p: F.size(p["strong"]) > 0).alias("has_strong"),
        (F.size(F.filter("_p", lambda p: p["bad"])) >= F.greatest(F.lit(1), F.floor(F.size("_p") / 2))).alias("conflict"),
    )
    ranked = joined.withColumns({"cells": F.col("rows"), "rows": F.size("rows"), "first_page": F.array_min("pages"), "last_page": F.array_max("pages"), "named": F.col("scope")})
    kept = segmenting.adopted(ranked, KEY, "named")
    out = kept.select("doc", "label", F.col("named").alias("scope"), "copy", "pages", "unit", aligned(F.col("header"), F.col("cells")).alias("_a"))
    out = out.select("doc", "label", "scope", "copy", "pages", "unit", "_a.header", "_a.rows", "_a.dropped")
    return joins.enriched(out.withColumn("table", F.element_at(F.create_map(*[F.lit(x) for kv in T.STATEMENTS.items() for x in kv]), F.col("label"))), manifest, ["doc"])
