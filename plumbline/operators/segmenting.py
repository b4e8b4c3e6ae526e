"""Which stretch of pages is a statement: gates, order of segments, extra copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.arrays import let

# Words of which a statement's own pages hold one, and the band of a page without header and footer.
GATE = {"BS": ["货币资金", "资产总计", "总资产", "资产合计"], "IS": ["营业收入", "营业总收入", "净利润"], "CF": ["经营活动产生的现金流量", "现金及现金等价物"]}
TOP, BOTTOM = 115, 740
GATE_ROWS, MIN_ROWS, NEAR = 150, 8, 6  # rows that a gate looks at, rows of a segment, pages to an extra one


def gates(rows: Column, words: dict[str, list[str]] = GATE) -> Column:
    """The kinds of statement a word of which the first rows of cells (array of arrays) hold."""
    flat = F.array_join(F.transform(F.slice(rows, 1, GATE_ROWS), lambda r: F.array_join(r, " ")), " ")
    held = lambda text, some: F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(text, w))
    return let(flat, lambda text: F.array_compact(F.array(*[F.when(held(text, some), F.lit(name)) for name, some in words.items()])))


def gate(rows: Column, kind: Column, words: dict[str, list[str]] = GATE) -> Column:
    """Whether the first rows of cells (array of arrays) hold a word of their own kind of statement."""
    return F.coalesce(F.array_contains(gates(rows, words), kind), F.lit(False))


def in_band(top: Column, low: float = TOP, high: float = BOTTOM) -> Column:
    """Whether something lies between a page's header and footer."""
    return top.between(low, high)


def cropped_or_raw(candidates: DataFrame, by: list[str], score: str, cropped: str) -> DataFrame:
    """Per page all candidates of the cropped page, if its best one is no worse
    than the best of the whole page, else those of the whole page."""
    w = Window.partitionBy(*by)
    best = lambda flag: F.max(F.when(flag, F.col(score))).over(w)
    own = candidates.withColumns({"_c": best(F.col(cropped)), "_r": best(~F.col(cropped))})
    crop = F.col("_c").isNotNull() & (F.col("_r").isNull() | (F.col("_c") >= F.col("_r")))
    return own.where(F.col(cropped) == crop).drop("_c", "_r")


def width(rows: Column) -> Column:
    """The most values in any of the rows (array of arrays), 0 if there are none."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def page_list(pages: Column) -> Column:
    """Pages sorted, each once."""
    return F.array_sort(F.array_distinct(pages))


def ordered(segments: DataFrame, by: list[str]) -> DataFrame:
    """segments (by, segment, first_page, last_page, rows, has_strong, conflict)
    with their rank: agreed ones first, then those with a strong label, then
    longer ones, then earlier ones."""
    w = Window.partitionBy(*by).orderBy(F.col("conflict").cast("int"), F.col("has_strong").cast("int").desc(), F.col("rows").desc(), "first_page", "segment")
    return segments.withColumn("rank", F.row_number().over(w))


def adopted(segments: DataFrame, by: list[str], scope: str, least: int = MIN_ROWS) -> DataFrame:
    """The main segment of each group and the extra copies near it: none where
    the main one is disputed or too short. Extra copies need half of its rows
    and start soon after it; their scope gets a suffix from #2 on."""
    w = Window.partitionBy(*by)
    main = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(w)
    all_ = ordered(segments, by).withColumns({"_conflict": main("conflict"), "_rows": main("rows"), "_end": main("last_page")})
    good = all_.where(~F.col("_conflict") & (F.col("_rows") >= least))
    extra = (F.col("rows") >= F.greatest(F.lit(least), F.floor(F.col("_rows") / 2))) & (F.col("first_page") <= F.col("_end") + NEAR)
    kept = good.where((F.col("rank") == 1) | extra)
    kept = kept.withColumn("copy", F.row_number().over(Window.partitionBy(*by).orderBy("rank")))
    named = F.when(F.col("copy") == 1, F.col(scope)).otherwise(F.concat(F.col(scope), F.lit("#"), F.col("copy").cast("string")))
    return kept.withColumn(scope, named).drop("_conflict", "_rows", "_end")
