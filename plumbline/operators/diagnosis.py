"""Why something went wrong: where a fact ranks, which pages disagree, what a page holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T

# Headings looked for on pages; the longest that a page holds counts.
PAGE_NAMES = ("合并资产负债表", "合并利润表", "合并现金流量表", "主要会计数据", "资产负债表", "利润表", "现金流量表")


def page_names(pages: DataFrame, text: str = "text", names: tuple[str, ...] = PAGE_NAMES) -> DataFrame:
    """Pages that hold one of the names, with the most specific one."""
    return pages.withColumn("name", T.most_specific(F.col(text), names)).where("name is not null")


def fault(ranks: DataFrame, hit: str, top: int = 6) -> DataFrame:
    """Blames retrieval where the fact's best rank is beyond the top, generation
    where it was shown and yet the answer missed it, the corpus where no chunk has it."""
    case = F.when(F.col(hit), "none").when(F.col("best_rank").isNull(), "corpus").when(F.col("best_rank") > top, "retrieval").otherwise("generation")
    return ranks.withColumn("fault", case)


def probe(picked: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Which of a question's facts each of its fragments holds: (by, rank, name,
    holds). picked: (by, rank, chunk), facts: (by, name, fact)."""
    both = picked.join(facts, by)
    return both.select(*by, "rank", "name", F.contains(T.compact(F.col("chunk")), T.compact(F.col("fact"))).alias("holds"))


def column_shapes(tables: DataFrame, by: list[str], rows: str = "rows") -> DataFrame:
    """What candidate tables (by, strategy, rows ARRAY<ARRAY<STRING>>) look
    like: columns, header and second row, cells cut to be read; of each page
    only the first strategy that found any."""
    w = Window.partitionBy(*by)
    first = tables.where(F.size(rows) > 0).withColumn("_first", F.min("strategy").over(w)).where("strategy = _first").drop("_first")
    cut = lambda i, n: F.transform(F.coalesce(F.get(F.col(rows), F.lit(i)), F.array().cast("array<string>")), lambda c: F.substring(F.coalesce(c, F.lit("")), 1, n))
    return first.select(*by, "strategy", F.size(F.get(F.col(rows), F.lit(0))).alias("columns"), cut(0, 16).alias("header"), cut(1, 14).alias("second"))


def worst_pages(agreed: DataFrame, most: int = 8, below: float = 0.8, *tie: str) -> DataFrame:
    """The pages on which two ways of reading agree least."""
    return agreed.where(F.col("rate") < below).orderBy("rate", *tie).limit(most)


def largest_gaps(frame: DataFrame, gap: str, most: int = 5, *tie: str) -> DataFrame:
    """The rows with the largest absolute gap; unknown gaps come last."""
    return frame.orderBy(F.abs(F.col(gap)).desc_nulls_last(), *tie).limit(most)
