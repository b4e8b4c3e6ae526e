"""Statement tables: cleaning, stitching, column profiles, identities, trust.

Canonical form is one row a cell (table_id, row_idx, label_norm, col_idx,
value). Verdicts are pass, fail or skip; a missing value is never zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.arrays import let
from plumbline.operators.joins import small, status_ladder

TOLERANCE = 0.02
WORD = 62  # bits that a whole number holds
SMALL, SHARE, LEAST = 1000, 0.5, 2  # note columns: small whole numbers in enough rows


def without_runners(rows: DataFrame, by: list[str], order: str, runner: Column) -> DataFrame:
    """Drops the leading rows for which runner holds, and no others."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_body", F.sum((~runner).cast("int")).over(w)).where("_body > 0").drop("_body")


def clean_rows(rows: DataFrame, cells: str) -> DataFrame:
    """Label and values of rows of cells; blank rows and the header row of items go."""
    c = F.transform(cells, lambda x: F.trim(F.translate(F.coalesce(x, F.lit("")), "\n", " ")))
    out = rows.withColumn("_c", c).where(F.exists("_c", lambda x: x != ""))
    out = out.withColumns({"label": F.get("_c", F.lit(0)), "vals": F.transform(F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0))), T.to_number)})
    return out.where(T.label(F.col("label")) != "项目").drop("_c")


def column_profile(lines: DataFrame, by: list[str], rows: int | Column | None = None) -> DataFrame:
    """Per column: filled cells, table rows, whether all values are small whole
    numbers (a column of note numbers), and whether it is kept."""
    n = Window.partitionBy(*by)
    p = lines.groupBy(*by, "col_idx").agg(F.count("value").alias("filled"), F.count("*").alias("cells"), F.coalesce(F.bool_and((F.abs("value") < SMALL) & (F.col("value") == F.floor("value"))), F.lit(False)).alias("small"))
    p = p.withColumn("rows", F.max("cells").over(n))
    enough = F.col("filled") >= F.greatest(F.lit(LEAST), SHARE * F.col("rows"))
    p = p.withColumns({"is_note": F.col("small") & enough, "enough": enough}).drop("small")
    any_kept = F.max((F.col("enough") & ~F.col("is_note")).cast("int")).over(n) == 1
    return p.withColumn("kept", ~F.col("is_note") & F.when(any_kept, F.col("enough")).otherwise(F.col("filled") > 0)).drop("enough")


def segments(pages: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """Stitches pages (page, width, strong ARRAY, rows, unit) to segments: a new
    one starts where pages aren't neighbours, the segment has ``most`` pages,
    known widths differ, or a strong label comes again. The decision needs what
    the segment holds so far, so it is one fold over a table's pages in order."""
    item = F.struct("page", "width", "strong", "rows", "unit")
    empty = "array<struct<first:int,last:int,n:int,width:int,seen:array<string>,rows:bigint,unit:string>>"

    def add(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        fresh = last.isNull() | (p["page"] != last["last"] + 1) | (last["n"] >= most) | ((p["width"] > 0) & (last["width"] > 0) & (p["width"] != last["width"])) | F.arrays_overlap(p["strong"], last["seen"])
        new = F.struct(p["page"].alias("first"), p["page"].alias("last"), F.lit(1).alias("n"), p["width"].alias("width"), p["strong"].alias("seen"), p["rows"].alias("rows"), p["unit"].alias("unit"))
        grown = F.struct(last["first"].alias("first"), p["page"].alias("last"), (last["n"] + 1).alias("n"), F.when(last["width"] > 0, last["width"]).otherwise(p["width"]).alias("width"), F.array_union(last["seen"], p["strong"]).alias("seen"), (last["rows"] + p["rows"]).alias("rows"), F.coalesce(last["unit"], p["unit"]).alias("unit"))
        return F.when(F.coalesce(fresh, F.lit(True)), F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))

    folded = pages.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_pages")).select(*by, F.aggregate("_pages", F.array().cast(empty), add).alias("_s"))
    return folded.select(*by, F.posexplode("_s").alias("segment", "s")).select(*by, "segment", F.col("s.first").alias("first_page"), F.col("s.last").alias("last_page"), F.col("s.n").alias("pages"), F.col("s.rows").alias("rows"), F.col("s.unit").alias("unit"))


def identity_residuals(lines: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """Per group, identity and column: lhs - sum(coef * value), how many
    required terms are missing, and which. lines: (by, concept, col_idx, value),
    one row a concept; terms: (ident, concept, coef, optional), the left side
    with -1. A group without any term of an identity has a row too."""
    required = F.array_sort(F.collect_set(F.when(~F.col("optional"), F.col("concept"))))
    idents = small(terms.groupBy("ident", "concept").agg(F.sum("coef").alias("coef"), F.bool_and("optional").alias("optional")).groupBy("ident").agg(required.alias("_need"), F.map_from_entries(F.collect_list(F.struct("concept", "coef"))).alias("_coef")))
    # required terms that are there are bits of whole numbers, as numbers are what sums are held in without sorting
    words = range(-(-(idents.agg(F.max(F.size("_need"))).first()[0] or 1) // WORD))
    cells = lines.crossJoin(idents).withColumns({"_c": F.try_element_at("_coef", F.col("concept")), "_at": F.array_position("_need", F.col("concept")).cast("int") - 1})
    bit = lambda k: F.when(F.col("value").isNotNull() & (F.col("_at") >= k * WORD) & (F.col("_at") < (k + 1) * WORD), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at") - k * WORD))
    sums = cells.groupBy(*by, "ident", "col_idx").agg(F.sum(F.col("_c") * F.col("value")).alias("_sum"), *[F.bit_or(bit(k)).alias(f"_w{k}") for k in words]).join(idents.drop("_coef"), "ident")
    lacks = lambda i: reduce(lambda acc, k: F.when(i >= k * WORD, F.getbit(F.coalesce(f"_w{k}", F.lit(0).cast("long")), i - k * WORD) == 0).otherwise(acc), words, F.lit(True))
    absent = F.filter("_need", lambda c, i: lacks(i))
    return sums.select(*by, "ident", "col_idx", (-F.col("_sum")).alias("residual"), F.size(absent).cast("long").alias("missing"), absent.alias("absent"))


def verdicts(residuals: DataFrame, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Over columns: any failure fails, else one success passes, else skip."""
    return explained(residuals, by, tolerance).drop("detail")


def explained(residuals: DataFrame, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(by, ident, verdict, detail): the verdict over columns, with the largest
    residual or the terms that are missing."""
    judged = F.when(F.col("missing") > 0, None).otherwise(F.abs("residual") <= tolerance)
    worst = F.max(F.when(F.col("missing") == 0, F.abs("residual")))
    per = residuals.withColumn("_ok", judged).groupBy(*by, "ident").agg(F.bool_and("_ok").alias("_all"), worst.alias("_worst"), F.min_by("absent", "missing").alias("_absent"))
    verdict = F.when(F.col("_all").isNull(), "skip").when(F.col("_all"), "pass").otherwise("fail")
    detail = F.when(F.col("_all").isNull(), F.concat(F.lit("missing "), F.array_join("_absent", ", "))).otherwise(F.concat(F.lit("residual "), F.format_string("%.2f", F.col("_worst").cast("double"))))
    return per.select(*by, "ident", verdict.alias("verdict"), detail.alias("detail"))


def whole_check(lines: DataFrame, facts: DataFrame, required: DataFrame, terms: DataFrame, ranges: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """(by, ident, verdict, detail) of all checks of a table: required rows,
    identities, range sums. lines: as for range_sums, facts: as for identities."""
    rows = missing_rows(lines, required, by)
    present = rows.select(*by, F.lit("required rows").alias("ident"), F.when(F.size("missing") > 0, "fail").otherwise("pass").alias("verdict"), F.when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", "))).otherwise("complete").alias("detail"))
    out = present.unionByName(explained(identity_residuals(facts, terms, by), by))
    for start, end in ranges:
        cells = range_sums(lines, by, start, end)
        gap = F.max(F.abs(F.col("inner_sum") - F.col("stated")))
        per = cells.groupBy(*by).agg(F.count_if(F.col("verdict") == "fail").alias("_bad"), F.count_if(F.col("verdict") == "pass").alias("_ok"), gap.alias("_gap"))
        verdict = F.when(F.col("_bad") > 0, "fail").when(F.col("_ok") > 0, "pass").otherwise("skip")
        detail = F.when(verdict == "skip", "no range").otherwise(F.concat(F.lit("residual "), F.format_string("%.2f", F.col("_gap").cast("double"))))
        out = out.unionByName(per.select(*by, F.lit(f"{start} to {end}").alias("ident"), verdict.alias("verdict"), detail.alias("detail")))
    return out


def check_totals(verdicts_: DataFrame, by: list[str], rollup: bool = True) -> DataFrame:
    """Passes, failures and skips of each group and, with rollup, of all (NULL
    keys), and the share of passes among those that could be judged."""
    groups = verdicts_.rollup(*by) if rollup else verdicts_.groupBy(*by)
    counts = [F.count_if(F.col("verdict") == v).alias(n) for v, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))]
    return groups.agg(*counts).withColumn("pass_rate", F.try_divide("passed", F.col("passed") + F.col("failed")))


def judged_rate(verdicts_: DataFrame, ident: str) -> DataFrame:
    """How many groups an identity could be judged in, of how many."""
    own = verdicts_.where(F.col("ident") == ident)
    return own.agg(F.count_if(F.col("verdict") != "skip").alias("judged"), F.count("*").alias("tables")).withColumn("rate", F.try_divide("judged", "tables"))


def range_sums(lines: DataFrame, by: list[str], start: str, end: str, anchor: str = "exact", tolerance: float = TOLERANCE) -> DataFrame:
    """The sum of rows strictly between the first label for start and the first
    equal to end, without rows marked as 'of which', against the end row.
    anchor: start labels equal (exact) or contain the name. Where any inner row
    has a value, a column whose inner cells are all empty sums to 0, so its
    stated total is judged; without such a row there is nothing to judge."""
    begins = F.col("label_norm") == start if anchor == "exact" else F.contains(F.col("label_norm"), F.lit(start))
    w = Window.partitionBy(*by)
    # labels aren't sorted, only what they say
    said = lines.select(*by, "row_idx", "col_idx", "value", begins.alias("_begins"), (F.col("label_norm") == end).alias("_ends"), (~F.contains(F.col("label_raw"), F.lit("其中"))).alias("_counts"))
    marked = said.withColumns({"_lo": F.min(F.when(F.col("_begins"), F.col("row_idx"))).over(w), "_hi": F.min(F.when(F.col("_ends"), F.col("row_idx"))).over(w)})
    inside = (F.col("row_idx") > F.col("_lo")) & (F.col("row_idx") < F.col("_hi")) & F.col("_counts")
    cells = marked.groupBy(*by, "col_idx").agg(F.sum(F.when(inside, F.col("value"))).alias("_sum"), F.max(F.when(F.col("row_idx") == F.col("_hi"), F.col("value"))).alias("stated"))
    filled = F.max(F.col("_sum").isNotNull()).over(w)
    sums = cells.withColumn("inner_sum", F.when(filled, F.coalesce("_sum", F.lit(0)))).select(*by, "col_idx", "inner_sum", "stated")
    return sums.withColumn("verdict", F.when(F.col("inner_sum").isNull() | F.col("stated").isNull(), "skip").when(F.abs(F.col("inner_sum") - F.col("stated")) <= tolerance, "pass").otherwise("fail"))


def missing_rows(lines: DataFrame, required: DataFrame, by: list[str]) -> DataFrame:
    """Per group the required names that no label equals or contains."""
    pairs = lines.select(*by, "label_norm").crossJoin(small(required)).groupBy(*by, "name").agg(F.bool_or(F.contains(F.col("label_norm"), F.col("name"))).alias("found"))
    return pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("name")))).alias("missing"))


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def skip_reasons(rows: DataFrame, detail: str, member: str) -> DataFrame:
    """Skips by the first characters of their detail, with the members they concern."""
    return rows.where("verdict = 'skip'").groupBy(F.substring(detail, 1, 24).alias("reason")).agg(F.array_sort(F.collect_set(member)).alias("members"))


def cross_document(left: DataFrame, right: DataFrame, keys: list[str], order: str, absolute: float = 1.0) -> DataFrame:
    """The same fact in two documents: rows joined on keys (first match on the
    right), compared where both are known."""
    once = right.groupBy(*keys).agg(F.min_by("value", order).alias("value_b"))
    both = left.select(*keys, F.col("value").alias("value_a")).join(once, keys).where("value_a is not null and value_b is not null")
    return both.withColumn("same", F.abs(F.col("value_a") - F.col("value_b")) <= F.greatest(F.lit(absolute), 1e-6 * F.abs("value_a")))


def agreement(compared: DataFrame, by: list[str], pages: DataFrame | None = None) -> DataFrame:
    """(by, compared, agreed, rate). With pages (by), each has a row: where
    nothing could be compared the rate is NULL."""
    out = compared.groupBy(*by).agg(F.count("*").alias("compared"), F.count_if("same").alias("agreed"))
    if pages is not None:
        out = pages.select(*by).distinct().join(out, by, "left").na.fill(0, ["compared", "agreed"])
    return out.withColumn("rate", F.try_divide("agreed", "compared"))


def dual_agreement(a: DataFrame, b: DataFrame, by: list[str], absolute: float = 1.0) -> DataFrame:
    """How far two parse paths of the same pages agree: (by, compared, agreed,
    rate), a row for each page on which both found rows. Each path counts with
    the first value of each label; labels that both have are compared. One
    grouping by label and one by page, whatever the number of labels."""
    both = a.select(*by, "label_norm", "row_idx", "col_idx", "value", F.lit(0).alias("_side")).unionByName(b.select(*by, "label_norm", "row_idx", "col_idx", "value", F.lit(1).alias("_side")))
    known = F.col("value").isNotNull() & (F.col("label_norm") != "")
    first = lambda side: F.min_by(F.when(known & (F.col("_side") == side), F.col("value")), F.when(known & (F.col("_side") == side), F.struct("row_idx", "col_idx", "value")))
    labels = both.groupBy(*by, "label_norm").agg(first(0).alias("value_a"), first(1).alias("value_b"), F.max(F.col("_side") == 0).alias("_in_a"), F.max(F.col("_side") == 1).alias("_in_b"))
    common = F.col("value_a").isNotNull() & F.col("value_b").isNotNull()
    same = F.abs(F.col("value_a") - F.col("value_b")) <= F.greatest(F.lit(absolute), 1e-6 * F.abs("value_a"))
    out = labels.groupBy(*by).agg(F.count_if(common).alias("compared"), F.count_if(common & same).alias("agreed"), F.max("_in_a").alias("_in_a"), F.max("_in_b").alias("_in_b"))
    return out.where("_in_a and _in_b").drop("_in_a", "_in_b").withColumn("rate", F.try_divide("agreed", "compared"))


def agreement_bucket(rate: Column) -> Column:
    return F.when(rate.isNull(), "none").when(rate >= 1, "1.00").when(rate >= 0.8, "0.80-0.99").when(rate >= 0.5, "0.50-0.79").otherwise("<0.50")


def conflicts(pages: DataFrame, by: list[str]) -> DataFrame:
    """Segments that disagree with the other parse path: pages with five common
    labels or more and a rate below 0.8, at least half of all and one."""
    bad = F.count_if((F.col("compared") >= 5) & (F.col("rate") < 0.8))
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), bad.alias("bad")).withColumn("conflict", F.col("bad") >= F.greatest(F.lit(1), F.floor(F.col("pages") / 2)))


def different(compared: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """The largest differences of each pair of documents, as one array a pair."""
    gap = F.struct((-F.abs(F.col("value_a") - F.col("value_b"))).alias("gap"), *[F.col(c) for c in compared.columns if c not in (*by, "same")])
    # aggregated as a sorted array that is cut in each partial result would need a custom aggregate; a rank keeps it bounded
    w = Window.partitionBy(*by).orderBy(gap)
    few = compared.where(~F.col("same")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list(gap)).alias("differences"))


def first_values(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, label_norm, value): of each label's first row with any value, the first column's that isn't NULL."""
    known = lines.where("value is not null and label_norm <> ''")
    return known.groupBy(*by, "label_norm").agg(F.min_by("value", F.struct("row_idx", "col_idx", "value")).alias("value"))


def mapped(rows: DataFrame, by: list[str]) -> DataFrame:
    """First row of each concept; (by, concept, row_idx, label_norm)."""
    return rows.where("concept is not null").groupBy(*by, "concept").agg(F.min("row_idx").alias("row_idx"), F.min_by("label_norm", "row_idx").alias("label_norm"))


def duplicate_claims(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows after a concept's first whose label differs from it."""
    first = mapped(rows, by).select(*by, "concept", F.col("label_norm").alias("_first"), F.col("row_idx").alias("_at"))
    return rows.join(first, [*by, "concept"]).where((F.col("row_idx") > F.col("_at")) & (F.col("label_norm") != F.col("_first"))).drop("_first", "_at")


def coverage(wanted: DataFrame, found: DataFrame, by: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Hits of all wanted concepts per group, with those that are missing.
    groups (by): all groups there are, so that one without any hit has a row."""
    groups = (found if groups is None else groups).select(*by).distinct()
    every = groups.crossJoin(small(wanted)).join(found.select(*by, "concept", F.lit(True).alias("_hit")).distinct(), [*by, "concept"], "left")
    return every.groupBy(*by).agg(F.count_if("_hit").alias("hits"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col("concept")))).alias("missing"))


def divergence(rows: DataFrame, member: str) -> DataFrame:
    """Concepts that go by more than one label."""
    return rows.groupBy("concept").agg(F.count_distinct("label_raw").alias("labels"), F.count_distinct(member).alias("members")).where("labels > 1")


def label_of_member(rows: DataFrame, member: str) -> DataFrame:
    """Of each concept with more than one label, the label that each member first gives it, as a map."""
    first = rows.groupBy("concept", member).agg(F.min_by("label_raw", "row_idx").alias("label"))
    out = first.groupBy("concept").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(member, "label")))).alias("by_member"))
    return out.where(F.size(F.array_distinct(F.map_values("by_member"))) > 1)


def candidate_score(flat: Column, signatures: dict[str, list[str]], noise: list[str], header: Column) -> Column:
    """The most signature words of any statement, less two for each noise word, plus two for a header with a year."""

    def of(text: Column) -> Column:
        own = [T.hits(text, w) for w in signatures.values()]
        return (F.greatest(*own) if len(own) > 1 else own[0]) - 2 * T.hits(text, noise)

    return let(flat, of) + F.when(header, 2).otherwise(0)


MIN_SCORE, ENOUGH = 2, 3  # of a candidate that counts at all, and from which no further strategy is tried


def short_circuit(candidates: DataFrame, by: list[str], rank: str, score: str, enough: int = ENOUGH, least: int | None = None) -> DataFrame:
    """Candidates up to the first strategy with a score that is enough; then
    the best, highest on the page first. Those below ``least`` don't count."""
    w = Window.partitionBy(*by)
    candidates = candidates if least is None else candidates.where(F.col(score) >= least)
    stop = F.min(F.when(F.col(score) >= enough, F.col(rank))).over(w)
    left = candidates.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(rank) <= F.col("_stop"))).drop("_stop")
    best = Window.partitionBy(*by).orderBy(F.col(score).desc(), "top", rank)
    return left.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def rebuilt_lines(words: DataFrame, by: list[str]) -> DataFrame:
    """Words with coordinates to lines of text: grouped by height, ordered from left."""
    line = F.bround(F.col("top") / 3).cast("long")
    rows = words.groupBy(*by, line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("_w"), F.min("top").alias("top"))
    return rows.select(*by, "line", "top", F.array_join(F.transform("_w", lambda w: w["text"]), "").alias("text"))


def cell_status(found: Column, value: Column, strong: Column, ident_fail: Column, unit: Column) -> tuple[Column, Column]:
    """The trust ladder of a comparison cell."""
    return status_ladder((~found, "?", "concept missing"), (value.isNull(), "⚠", "extraction gap"), (~strong, "⚠", "no strong label"), (ident_fail, "⚠", "identity fails"), (unit.isNull(), "⚠", "unit unknown"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return 100 * F.try_divide(numerator, denominator)


# Mutations that the checks must catch.


def drop_row(lines: DataFrame, label: str) -> DataFrame:
    return lines.where(F.col("label_norm") != label)


def shift_value(lines: DataFrame, label: str, by: float) -> DataFrame:
    return lines.withColumn("value", F.when(F.col("label_norm") == label, F.col("value") + by).otherwise(F.col("value")))


def scale_value(lines: DataFrame, factor: float, label: str | None = None) -> DataFrame:
    hit = F.lit(True) if label is None else F.col("label_norm") == label
    return lines.withColumn("value", F.when(hit, F.col("value") * factor).otherwise(F.col("value")))


def reverse_columns(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.withColumn("col_idx", F.max("col_idx").over(Window.partitionBy(*by)) - F.col("col_idx"))


def overwrite_value(lines: DataFrame, label: str, value: float) -> DataFrame:
    return lines.withColumn("value", F.when(F.col("label_norm") == label, F.lit(value)).otherwise(F.col("value")))


def bump_value(lines: DataFrame, label: str, by: float) -> DataFrame:
    """Only the first column's value of a row."""
    hit = (F.col("label_norm") == label) & (F.col("col_idx") == 0)
    return lines.withColumn("value", F.when(hit, F.col("value") + by).otherwise(F.col("value")))


def caught(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, was, now) of verdicts that a mutation changed; what can't be judged any more counts."""
    a, b = (df.select(*keys, F.col("verdict").alias(n)) for df, n in ((before, "was"), (after, "now")))
    return a.join(b, keys, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def merge_concept(aliases: DataFrame, source: str, target: str) -> DataFrame:
    return aliases.withColumn("concept", F.when(F.col("concept") == source, target).otherwise(F.col("concept")))


def drop_alias(aliases: DataFrame, alias: str) -> DataFrame:
    return aliases.where(F.col("alias") != alias)
