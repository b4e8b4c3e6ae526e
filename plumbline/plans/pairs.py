"""Queries across documents and corruptions. A customer is a company whose orders
are its filings: each filing is a statement with a column for its own day and one
for that of the filing before, as two filings of one company share a date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import crossdoc, joins, mutations
from plumbline.plans.market import table

ROW = "l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey"


def _filings(spark, sf_dir):
    """(entity, doc, day, total, part) of each order and of the one before it."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    part = F.when(F.col("o_orderkey") % 9 > 0, F.round(F.col("o_totalprice") * 10).cast("long"))
    now = o.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("doc"), F.date_format("o_orderdate", "yyyy年M月d日").alias("day"), cents.alias("total"), part.alias("part"))
    before = [F.lag(c).over(Window.partitionBy("entity").orderBy("doc")).alias(f"{c}_before") for c in ("day", "total", "part")]
    return now.select("*", *before)


def _cells(spark, sf_dir, turned=False):
    """The filings' cells; restated: every eleventh filing gives the earlier total one more."""
    f = _filings(spark, sf_dir)
    restated = F.col("total_before") + F.when(F.col("doc") % 11 == 0, 100).otherwise(0)
    cell = lambda n, label, k, header, value: F.struct(F.lit(n).alias("row_idx"), F.lit(label).alias("label_raw"), F.lit(k).alias("col_idx"), header.alias("header_text"), value.cast("double").alias("value"))
    now, before = F.col("day"), F.col("day_before")
    pairs = [(0, "一、资产总计", F.col("total"), restated), (1, "其中：货币资金", F.col("part"), F.col("part_before")), (2, "资产总计", F.lit(1), F.lit(1))]
    cells = [c for n, label, a, b in pairs for c in (cell(n, label, 0, now, b if turned else a), cell(n, label, 1, before, a if turned else b))]
    return f.select("entity", "doc", F.inline(F.array(*cells)))


def document_pairs(spark, sf_dir):
    """All pairs of filings of a company that share a date, with their agreement and first difference."""
    p = crossdoc.pairs(crossdoc.dated_facts(_cells(spark, sf_dir), ["entity"], "doc"), ["entity"])
    first = F.get("differences", F.lit(0))
    return p.select("entity", "date", "doc_a", "doc_b", "compared", "same", "rate", F.size("differences").alias("different"), first["label"].alias("label"), first["a"].alias("a"), first["b"].alias("b"))


def turned_pairs(spark, sf_dir):
    """The negative control: filings whose columns are the wrong way round, against the right ones of others."""
    turned = crossdoc.dated_facts(_cells(spark, sf_dir, True), ["entity"], "doc")
    return crossdoc.total(turned, ["entity"], crossdoc.dated_facts(_cells(spark, sf_dir), ["entity"], "doc"))


DEALT = 1 << 17  # line items of the tables that one task reads


def _statement(spark, sf_dir):
    """Rows (table_id, row_idx, label_norm, label_raw, concept, vals), dealt by table: a
    heading, items and their sum, charges and the whole, for this period and the last."""
    l = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sums = joins.dealt(l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"), ["l_orderkey"], DEALT)
    sums = sums.select(F.col("l_orderkey").alias("table_id"), F.expr(ROW).alias("n"), cents.alias("a"), (cents + F.col("l_quantity").cast("long")).alias("b"), F.round(cents * F.col("l_tax")).cast("long").alias("t"))
    w = Window.partitionBy("table_id").orderBy("n")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = sums.withColumns({"_n": F.row_number().over(w), **{f"_{c}": F.sum(c).over(all_) for c in ("a", "b", "t")}})
    row = lambda k, label, concept, *v: F.struct(k.cast("long").alias("row_idx"), label.alias("label_norm"), F.lit(concept).cast("string").alias("concept"), F.array(*v).alias("vals"))
    last, none = 10**18, F.lit(None).cast("long")
    ends = [(-1, "items", None, none, none), (last, "sum of items", "items", F.col("_a"), F.col("_b")), (last + 1, "charges", "charges", F.col("_t"), F.when(F.col("_t") % 2 == 0, F.col("_t"))), (last + 2, "whole", "whole", F.col("_a") + F.col("_t"), F.col("_b") + F.col("_t"))]
    item = row(F.col("n"), F.concat(F.lit("item "), F.col("n").cast("string")), None, F.col("a"), F.col("b"))
    rows = F.when(F.col("_n") == 1, F.array(item, *[row(F.lit(k), F.lit(label), *rest) for k, label, *rest in ends])).otherwise(F.array(item))
    return own.select("table_id", F.inline(rows)).withColumn("label_raw", F.col("label_norm"))


CASES = {
    "row dropped": mutations.drop_row("whole"), "one more": mutations.bump("sum of items", 1), "shifted point": mutations.scale(10, "charges"), "wrong unit": mutations.scale(10000),
    "columns reversed": mutations.reverse(), "overwritten": mutations.overwrite("whole", 1.0),
}


def mutation_grid(spark, sf_dir):
    """Corruptions of every order's statement against all checks, in one plan."""
    whole = {"whole = items + charges": [("whole", -1, False), ("items", 1, False), ("charges", 1, False)]}
    return mutations.side_by_side(_statement(spark, sf_dir), CASES, ["table_id"], ["day 0", "day 1"], whole, ["whole"], [("items", "sum of items")])


QUERIES = {f.__name__: f for f in (document_pairs, turned_pairs, mutation_grid)}

FILED = """
f AS (SELECT o_custkey AS entity, o_orderkey AS doc, strftime(o_orderdate, '%Y年%-m月%-d日') AS day, round(o_totalprice * 100)::BIGINT AS total, CASE WHEN o_orderkey % 9 > 0 THEN round(o_totalprice * 10)::BIGINT END AS part FROM orders),
b AS (SELECT *, lag(day) OVER o AS day_before, lag(total) OVER o AS total_before, lag(part) OVER o AS part_before FROM f WINDOW o AS (PARTITION BY entity ORDER BY doc)),
c AS (SELECT entity, doc, unnest([{'k': 0, 'date': day, 't': total, 'p': part}, {'k': 1, 'date': day_before, 't': total_before + CASE WHEN doc % 11 = 0 THEN 100 ELSE 0 END, 'p': part_before}]) AS x, total, part, total_before + CASE WHEN doc % 11 = 0 THEN 100 ELSE 0 END AS tb, part_before AS pb FROM b),
d AS (SELECT entity, doc, x.date AS date, x.t AS t, x.p AS p, CASE WHEN x.k = 0 THEN tb ELSE total END AS rt, CASE WHEN x.k = 0 THEN pb ELSE part END AS rp FROM c WHERE x.date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, doc, x.date ORDER BY x.k) = 1)"""

MUTATED = """
l AS (SELECT l_orderkey AS table_id, l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey AS n, round(l_extendedprice * 100)::BIGINT AS a, round(l_extendedprice * 100)::BIGINT + l_quantity::BIGINT AS b, round(round(l_extendedprice * 100)::BIGINT * l_tax)::BIGINT AS t FROM lineitem),
s AS (SELECT table_id, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(t)::BIGINT AS t FROM l GROUP BY 1),
rows AS (SELECT table_id, n AS row_idx, 'item ' || n AS label, a AS v0, b AS v1 FROM l UNION ALL SELECT table_id, unnest([-1, 1000000000000000000, 1000000000000000001, 1000000000000000002]), unnest(['items', 'sum of items', 'charges', 'whole']), unnest([NULL, a, t, a + t]), unnest([NULL, b, CASE WHEN t % 2 = 0 THEN t END, b + t]) FROM s),
cells AS (SELECT table_id, row_idx, label, unnest([0, 1]) AS col, unnest([v0, v1]) AS v, unnest([v1, v0]) AS r FROM rows),
m AS (SELECT mutation, table_id, row_idx, label, col, v AS original, CASE WHEN mutation = 'one more' AND label = 'sum of items' AND col = 0 THEN v + 1 WHEN mutation = 'shifted point' AND label = 'charges' THEN v * 10 WHEN mutation = 'wrong unit' THEN v * 10000 WHEN mutation = 'columns reversed' THEN r WHEN mutation = 'overwritten' AND label = 'whole' THEN 1 ELSE v END::DOUBLE AS v
  FROM cells, (SELECT unnest(['none', 'row dropped', 'one more', 'shifted point', 'wrong unit', 'columns reversed', 'overwritten']) AS mutation) WHERE NOT (mutation = 'row dropped' AND label = 'whole')),
w AS (SELECT mutation, table_id, col, max(v) FILTER (label = 'whole') AS whole, max(v) FILTER (label = 'sum of items') AS items, max(v) FILTER (label = 'charges') AS charges, sum(v) FILTER (starts_with(label, 'item ')) AS inner_sum, bool_or(label = 'whole') AS has FROM m GROUP BY ALL),
i AS (SELECT mutation, table_id, 'whole = items + charges' AS detector, CASE WHEN bool_or(abs(items + charges - whole) > 0.02) THEN 'fail' WHEN bool_or(abs(items + charges - whole) <= 0.02) THEN 'pass' ELSE 'skip' END AS verdict FROM w GROUP BY ALL),
g AS (SELECT mutation, table_id, 'items to sum of items' AS detector, CASE WHEN bool_or(abs(inner_sum - items) > 0.02) THEN 'fail' WHEN bool_or(abs(inner_sum - items) <= 0.02) THEN 'pass' ELSE 'skip' END AS verdict FROM w GROUP BY ALL),
q AS (SELECT mutation, table_id, 'required rows' AS detector, CASE WHEN bool_or(has) THEN 'pass' ELSE 'fail' END AS verdict FROM w GROUP BY ALL),
x AS (SELECT mutation, table_id, 'other document' AS detector, CASE WHEN bool_or(abs(v - original) > 0.02) THEN 'fail' WHEN bool_or(abs(v - original) <= 0.02) THEN 'pass' ELSE 'skip' END AS verdict FROM m GROUP BY ALL),
u AS (SELECT * FROM i UNION ALL SELECT * FROM g UNION ALL SELECT * FROM q UNION ALL SELECT * FROM x)"""

ORACLES = {
    "document_pairs": f"""WITH {FILED}, p AS (SELECT a.entity, a.date, a.doc AS doc_a, b.doc AS doc_b, a.t AS ta, b.t AS tb, a.p AS pa, b.p AS pb FROM d a JOIN d b ON a.entity = b.entity AND a.date = b.date AND a.doc < b.doc),
n AS (SELECT *, (ta IS NOT NULL AND tb IS NOT NULL)::INT + (tb IS NOT NULL)::INT + (pa IS NOT NULL AND pb IS NOT NULL)::INT AS compared, coalesce((abs(ta - tb) <= 0.02)::INT, 0) + coalesce((abs(1 - tb) <= 0.02)::INT, 0) + coalesce((abs(pa - pb) <= 0.02)::INT, 0) AS same,
  list_filter([CASE WHEN abs(ta - tb) > 0.02 THEN {{'label': '资产总计', 'a': ta::DOUBLE, 'b': tb::DOUBLE}} END, CASE WHEN abs(pa - pb) > 0.02 THEN {{'label': '货币资金', 'a': pa::DOUBLE, 'b': pb::DOUBLE}} END, CASE WHEN abs(1 - tb) > 0.02 THEN {{'label': '资产总计', 'a': 1::DOUBLE, 'b': tb::DOUBLE}} END], lambda y: y IS NOT NULL) AS wrong FROM p)
SELECT entity, date, doc_a, doc_b, compared, same, same / nullif(compared, 0) AS rate, len(wrong) AS different, wrong[1].label AS label, wrong[1].a AS a, wrong[1].b AS b FROM n""",
    "turned_pairs": f"""WITH {FILED}, p AS (SELECT a.rt AS ta, b.t AS tb, a.rp AS pa, b.p AS pb FROM d a JOIN d b ON a.entity = b.entity AND a.date = b.date AND a.doc <> b.doc)
SELECT sum((ta IS NOT NULL AND tb IS NOT NULL)::INT + (tb IS NOT NULL)::INT + (pa IS NOT NULL AND pb IS NOT NULL)::INT)::BIGINT AS compared, sum(coalesce((abs(ta - tb) <= 0.02)::INT, 0) + coalesce((abs(1 - tb) <= 0.02)::INT, 0) + coalesce((abs(pa - pb) <= 0.02)::INT, 0))::BIGINT AS same FROM p""",
    "mutation_grid": f"""WITH {MUTATED} SELECT u.mutation, detector, count(*) FILTER (u.verdict <> o.verdict) AS caught, count(*) AS tables FROM u JOIN (SELECT table_id, detector, verdict FROM u WHERE mutation = 'none') o USING (table_id, detector) WHERE u.mutation <> 'none' GROUP BY 1, 2""",
}
