"""The same fact in all documents that state it: pairs of documents by the dates
of their columns.

Facts are long: one row a cell with its own column's header, so a value can't
lose its date. Two documents are compared for each statement and each header
date that both have. A fact of the first document meets the first row of the
second with the same label. The join is on entity, statement, date and label, so
documents that share no date never meet; keys that occur in very many documents
are split by salt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T

TOLERANCE = 0.02
HOT, SALTS = 10_000, 64  # facts of one key from which it is split, and into how many parts
SHOWN = 8  # differences of a pair that are shown, the first in order of rows


def dated_facts(lines: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """(keys, doc, date, label_norm, row_idx, value) of cells (keys, doc,
    row_idx, label_raw, header_text, value; label_norm is taken where there is
    one): the header without white space is the date, and headers without a
    digit are none; of columns with equal headers the first counts."""
    label = F.col("label_norm") if "label_norm" in lines.columns else T.label(F.col("label_raw"), ascii_colon=True)
    dated = lines.where("header_text rlike '[0-9]'").select(
        *keys, F.col(doc).alias("doc"), F.regexp_replace("header_text", T.BLANK, "").alias("date"), label.alias("label_norm"), "row_idx", "col_idx", "value"
    )
    return dated.groupBy(*keys, "doc", "date", "label_norm", "row_idx").agg(F.min_by("value", "col_idx").alias("value"))


def _first(right: DataFrame, on: list[str]) -> DataFrame:
    """(on, doc_b, b): the value of each label's first row."""
    return right.where("label_norm <> ''").groupBy(*on, F.col("doc").alias("doc_b")).agg(F.min_by("value", "row_idx").alias("b"))


def _met(left: DataFrame, once: DataFrame, on: list[str]) -> DataFrame:
    """The join on ``on``, by salt where a key is hot. Hot keys are broadcast: there is one in HOT rows at most."""
    hot = F.broadcast(once.groupBy(*on).count().where(F.col("count") > HOT).select(*on, F.lit(SALTS).alias("_parts")))
    left = left.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("doc_a"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    once = once.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(once, [*on, "_salt"])


def total(facts: DataFrame, keys: list[str], other: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of compared and same over all documents of facts and those of
    other but their namesakes, without a row for each pair. NULL if no two have
    a date and a label in common."""
    on = [*keys, "date", "label_norm"]
    left = facts.where("label_norm <> ''").select(*on, F.col("doc").alias("doc_a"), F.col("value").alias("a"))
    met = _met(left, _first(other, on), on).where("doc_a <> doc_b")
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return met.agg(number(known).alias("compared"), number(known & (F.abs(F.col("a") - F.col("b")) <= tolerance)).alias("same"))


def pairs(facts: DataFrame, keys: list[str], other: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, date, doc_a, doc_b, compared, same, rate, differences): each pair
    of documents (in order) with a date in common; with ``other``, each document
    of facts with each of other but itself's namesake left in. The rate of a
    pair without common labels is NULL. differences: (label, a, b)."""
    right = facts if other is None else other
    met = [*keys, "date"]
    ordered = F.col("doc_a") < F.col("doc_b") if other is None else F.lit(True)
    a_docs, b_docs = (df.select(*met, F.col("doc").alias(n)).distinct() for df, n in ((facts, "doc_a"), (right, "doc_b")))
    every = a_docs.join(b_docs, met).where(ordered)

    on = [*met, "label_norm"]
    once = _first(right, on).where("b is not null")
    left = facts.where("value is not null and label_norm <> ''").select(*on, F.col("doc").alias("doc_a"), "row_idx", F.col("value").alias("a"))
    compared = _met(left, once, on).where(ordered).withColumn("_same", F.abs(F.col("a") - F.col("b")) <= tolerance)
    wrong = F.collect_list(F.when(~F.col("_same"), F.struct("row_idx", F.col("label_norm").alias("label"), "a", "b")))
    # a pair's differences are rows of one table
    sums = compared.groupBy(*met, "doc_a", "doc_b").agg(F.count("*").alias("compared"), F.count_if("_same").alias("same"), F.slice(F.array_sort(wrong), 1, SHOWN).alias("_d"))
    shown = F.transform(F.coalesce("_d", F.array()), lambda d: d.dropFields("row_idx"))
    out = every.join(sums, [*met, "doc_a", "doc_b"], "left").na.fill(0, ["compared", "same"])
    return out.withColumns({"rate": F.try_divide("same", "compared"), "differences": shown}).drop("_d")


def rates(facts: DataFrame, other: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, doc, compared, same): what each document of facts has in common with
    one other, over all dates. other: one document a key. Each document that
    shares a date with it has a row. One window instead of joins, so that facts
    that are dealt by keys stay where they are."""
    both = facts.select(*keys, "doc", "date", "label_norm", "row_idx", "value", F.lit(False).alias("_other")).unionByName(other.select(*keys, "doc", "date", "label_norm", "row_idx", "value", F.lit(True).alias("_other")))
    w = Window.partitionBy(*keys, "date", "label_norm")
    b = F.min_by(F.when(F.col("_other"), F.col("value")), F.when(F.col("_other"), F.col("row_idx"))).over(w)
    dated = F.max("_other").over(Window.partitionBy(*keys, "date"))
    met = both.withColumn("_b", b).withColumn("_dated", dated).where("not _other and _dated")
    known = (F.col("label_norm") != "") & F.col("value").isNotNull() & F.col("_b").isNotNull()
    return met.groupBy(*keys, "doc").agg(F.count_if(known).alias("compared"), F.count_if(known & (F.abs(F.col("value") - F.col("_b")) <= tolerance)).alias("same"))
