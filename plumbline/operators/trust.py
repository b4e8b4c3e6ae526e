"""Which cells of a comparison can be trusted: table facts, revenue basis, ladders.

A cell is usable only if its table holds a strong label, none of its identities
fails, and its unit is known. What is missing is told from what failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import small, status_ladder

# Labels that only the right statement has, and the two revenue concepts in order of preference.
STRONG = {"BS": ["货币资金", "资产总计"], "IS": ["营业总收入", "净利润"], "CF": ["经营活动产生的现金流量净额", "期末现金及现金等价物余额"]}
REVENUE = ("营业总收入", "营业收入")


def table_trust(lines: DataFrame, verdicts: DataFrame, strong: DataFrame, by: list[str]) -> DataFrame:
    """(by, strong, unit_known, ident_fail) of each table. lines: (by,
    label_norm, unit), verdicts: (by, ident, verdict), strong: (label)."""
    labels = lines.select(*by, "label_norm").distinct().join(small(strong), F.contains(F.col("label_norm"), F.col("label")), "left_semi").select(*by).distinct().withColumn("_strong", F.lit(True))
    units = lines.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("unit").isNotNull()), F.lit(False)).alias("unit_known"))
    fails = verdicts.groupBy(*by).agg(F.bool_or(F.col("verdict") == "fail").alias("_fail"))
    no = F.lit(False)
    return units.join(labels, by, "left").join(fails, by, "left").select(*by, F.coalesce("_strong", no).alias("strong"), "unit_known", F.coalesce("_fail", no).alias("ident_fail"))


def downgraded(status: Column, why: Column, strong: Column, ident_fail: Column, unit_known: Column) -> tuple[Column, Column]:
    """The ladder of a table for a cell that is derived from its values: only
    what was usable before can lose it."""
    own, reason = status_ladder((~strong, "⚠", "no strong label"), (ident_fail, "⚠", "identity fails"), (~unit_known, "⚠", "unit unknown"))
    usable = status == "✓"
    return F.when(usable, own).otherwise(status), F.when(usable & (own != "✓"), reason).otherwise(why)


def revenue(preferred: Column, other: Column, names: tuple[str, str] = REVENUE) -> Column:
    """Struct of value and the concept it comes from: the preferred one, else the other."""
    return F.struct(F.coalesce(preferred, other).alias("value"), F.when(preferred.isNotNull(), names[0]).when(other.isNotNull(), names[1]).alias("basis"))


def gap_percent(a: Column, b: Column) -> Column:
    """How much a is above b, in per cent of b."""
    return 100 * F.try_divide(a - b, b)


def scope_gap(facts: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, value_a, value_b, gap, gap_pct, why) of two concepts: a missing row
    is told from a row without a value. facts: (by, concept, value)."""
    of = lambda c: (F.max(F.when(F.col("concept") == c, F.col("value"))), F.count_if(F.col("concept") == c))
    (va, na), (vb, nb) = of(a), of(b)
    wide = facts.groupBy(*by).agg(va.alias("value_a"), na.alias("_na"), vb.alias("value_b"), nb.alias("_nb"))
    lack = lambda v, n, c: F.when(F.col(v).isNull(), F.when(F.col(n) == 0, f"{c}: no row").otherwise(f"{c}: no value"))
    why = F.concat_ws("; ", lack("value_a", "_na", a), lack("value_b", "_nb", b))
    return wide.select(*by, "value_a", "value_b", (F.col("value_a") - F.col("value_b")).alias("gap"), gap_percent(F.col("value_a"), F.col("value_b")).alias("gap_pct"), F.nullif(why, F.lit("")).alias("why"))


def bench(members: DataFrame, tables: DataFrame, coverage: DataFrame, verdicts: DataFrame, member: str, kinds: int = 3) -> DataFrame:
    """Per member and, with NULL, in total: tables present and missing, concepts
    hit and wanted, identities passed, failed and skipped, and the pass rate.
    members: (member), all there are, with tables or without; tables: (member,
    kind), coverage: (member, hits, total), verdicts: (member, verdict)."""
    found = tables.groupBy(member).agg(F.count_distinct("kind").alias("present"))
    have = members.select(member).distinct().join(found, member, "left").na.fill(0, ["present"]).withColumn("absent", F.lit(kinds) - F.col("present"))
    hit = coverage.groupBy(member).agg(F.sum("hits").alias("hits"), F.sum("total").alias("wanted"))
    judged = verdicts.groupBy(member).agg(*[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))])
    wide = have.join(hit, member, "left").join(judged, member, "left").na.fill(0)
    sums = [F.sum(c).alias(c) for c in wide.columns if c != member]
    return wide.rollup(member).agg(*sums).withColumn("pass_rate", F.try_divide("passed", F.col("passed") + F.col("failed")))


def members_by_unit(tables: DataFrame, member: str) -> DataFrame:
    """Units with the sorted set of members that use them; '?' stands for unknown ones."""
    return tables.groupBy(F.coalesce("unit", F.lit("?")).alias("unit")).agg(F.array_sort(F.collect_set(member)).alias("members"))


def table_missing(wanted: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of tables that aren't there: (keys, status, why)."""
    return wanted.join(tables, keys, "left_anti").select(*keys, F.lit("?").alias("status"), F.concat(F.lit("no table "), F.col(keys[-1])).alias("why"))
