"""Queries on statement tables: each order is a table, its lines are rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.functions import text as T
from plumbline.operators import diagnosis, joins, mutations, patterns, segmenting, trust
from plumbline.operators import statements as S
from plumbline.plans.market import table

LABELS = "CASE l_linenumber % 4 WHEN 0 THEN 'assets' WHEN 1 THEN 'cash and assets' WHEN 2 THEN 'equity' ELSE 'debt' END"

ROW = "l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey"  # line numbers alone aren't unique within an order


def _lines(spark, sf_dir, by_table=False):
    """(table_id, row_idx, label_norm, label_raw, col_idx, value) in whole cents; two value columns, the second with gaps.
    by_table: each table's rows are in one partition, for queries that group and sort by table."""
    l = table(spark, sf_dir, "lineitem")
    l = joins.dealt(l, ["l_orderkey"]) if by_table else l
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    second = F.when(F.col("l_quantity") > 10, cents + F.when(F.col("l_returnflag") == "R", 5).otherwise(0))
    rows = l.select(F.col("l_orderkey").alias("table_id"), F.expr(ROW).alias("row_idx"), "l_linenumber", F.expr(LABELS).alias("label_norm"), F.posexplode(F.array(cents, second)).alias("col_idx", "value"))
    return rows.withColumn("label_raw", F.when(F.col("l_linenumber") % 6 == 5, F.concat(F.lit("其中："), "label_norm")).otherwise(F.col("label_norm"))).drop("l_linenumber")


LINES = f"""
base AS (SELECT l_orderkey AS table_id, l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey AS row_idx, l_linenumber, {LABELS} AS label_norm, round(l_extendedprice * 100)::BIGINT AS c, l_quantity, l_returnflag FROM lineitem),
lines AS (SELECT table_id, row_idx, label_norm, CASE WHEN l_linenumber % 6 = 5 THEN '其中：' || label_norm ELSE label_norm END AS label_raw, 0 AS col_idx, c AS value FROM base
  UNION ALL SELECT table_id, row_idx, label_norm, CASE WHEN l_linenumber % 6 = 5 THEN '其中：' || label_norm ELSE label_norm END, 1, CASE WHEN l_quantity > 10 THEN c + CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END END FROM base)"""


def column_profiles(spark, sf_dir):
    return S.column_profile(_lines(spark, sf_dir), ["table_id"]).select("table_id", "col_idx", "filled", "rows", "is_note", "kept")


def _facts(spark, sf_dir, by_table=False):
    """One row a concept of each order: total, net, tax and an optional discount, in cents; by_table as above."""
    l = table(spark, sf_dir, "lineitem")
    l = joins.dealt(l, ["l_orderkey"]) if by_table else l
    cents = lambda c: F.round(c * 100).cast("long")
    net = cents(F.col("l_extendedprice"))
    tax = F.round(net * F.col("l_tax")).cast("long")
    off = F.when(F.col("l_discount") > 0.05, F.lit(100).cast("long"))
    sums = l.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.sum(net).alias("net"), F.sum(F.when(F.col("l_tax") < 0.08, tax)).alias("tax"), F.sum(off).alias("off"), F.sum(net + tax).alias("all"))
    total = F.when(F.col("table_id") % 5 == 0, F.col("all")).otherwise(F.coalesce(F.col("net") + F.col("tax") - F.coalesce("off", F.lit(0)), "all"))
    wide = sums.select("table_id", total.alias("total"), "net", "tax", "off")
    return wide.select("table_id", F.explode(F.create_map(*[x for c in ("total", "net", "tax", "off") for x in (F.lit(c), F.col(c))])).alias("concept", "value")).withColumn("col_idx", F.lit(0))


FACTS = """
l AS (SELECT l_orderkey AS table_id, round(l_extendedprice * 100)::BIGINT AS net, l_tax, l_discount FROM lineitem),
s AS (SELECT table_id, sum(net)::BIGINT AS net, sum(CASE WHEN l_tax < 0.08 THEN round(net * l_tax)::BIGINT END)::BIGINT AS tax, sum(CASE WHEN l_discount > 0.05 THEN 100 END)::BIGINT AS off, sum(net + round(net * l_tax)::BIGINT)::BIGINT AS al FROM l GROUP BY 1),
f AS (SELECT table_id, CASE WHEN table_id % 5 = 0 THEN al ELSE coalesce(net + tax - coalesce(off, 0), al) END AS total, net, tax, off FROM s),
v AS (SELECT table_id, total - net - coalesce(tax, 0) + coalesce(off, 0) AS residual, (tax IS NULL)::INT AS missing FROM f),
verdicts AS (SELECT table_id, 'total = net + tax - off' AS ident, CASE WHEN missing > 0 THEN 'skip' WHEN abs(residual) <= 0.02 THEN 'pass' ELSE 'fail' END AS verdict FROM v)"""


def _terms(spark):
    n = "total = net + tax - off"
    return spark.createDataFrame([(n, "total", -1, False), (n, "net", 1, False), (n, "tax", 1, False), (n, "off", -1, True)], "ident string, concept string, coef int, optional boolean")


def identity_verdicts(spark, sf_dir):
    return S.verdicts(S.identity_residuals(_facts(spark, sf_dir, True), _terms(spark), ["table_id"]), ["table_id"])


def verdict_counts(spark, sf_dir):
    return S.verdict_counts(identity_verdicts(spark, sf_dir))


def range_sums(spark, sf_dir):
    return S.range_sums(_lines(spark, sf_dir, True), ["table_id"], "cash and assets", "equity", "exact")


def range_sums_loose(spark, sf_dir):
    return S.range_sums(_lines(spark, sf_dir, True), ["table_id"], "assets", "debt", "contains")


def range_sql(start: str, end: str) -> str:
    return f"""WITH {LINES}, m AS (SELECT *, min(row_idx) FILTER ({start}) OVER (PARTITION BY table_id) AS lo, min(row_idx) FILTER (label_norm = '{end}') OVER (PARTITION BY table_id) AS hi FROM lines),
p AS (SELECT table_id, col_idx, sum(value) FILTER (row_idx > lo AND row_idx < hi AND NOT contains(label_raw, '其中'))::BIGINT AS own, max(value) FILTER (row_idx = hi) AS stated FROM m GROUP BY 1, 2),
s AS (SELECT table_id, col_idx, CASE WHEN bool_or(own IS NOT NULL) OVER (PARTITION BY table_id) THEN coalesce(own, 0) END AS inner_sum, stated FROM p)
SELECT *, CASE WHEN inner_sum IS NULL OR stated IS NULL THEN 'skip' WHEN abs(inner_sum - stated) <= 0.02 THEN 'pass' ELSE 'fail' END AS verdict FROM s"""


def missing_rows(spark, sf_dir):
    required = spark.createDataFrame([("assets",), ("debt",), ("equity",)], "name string")
    return S.missing_rows(_lines(spark, sf_dir, True), required, ["table_id"])


def fuzzy_rows(spark, sf_dir):
    """Per order the row for 'assets': equal label first, else the shortest that contains it."""
    slots = spark.createDataFrame([("a", "assets"), ("e", "equity")], "slot string, name string")
    rows = _lines(spark, sf_dir).where("col_idx = 0")
    return patterns.fuzzy(rows, slots, ["table_id"], order=F.struct("row_idx", "value")).select("table_id", "slot", "row_idx", "value")


def cross_document(spark, sf_dir):
    """The two value columns of each order as two readings of it: agreement and
    its bucket, which is none where they have no label in common."""
    lines = _lines(spark, sf_dir)
    out = S.dual_agreement(lines.where("col_idx = 0"), lines.where("col_idx = 1"), ["table_id"])
    return out.withColumn("bucket", S.agreement_bucket(F.col("rate")))


def agreement_histogram(spark, sf_dir):
    return cross_document(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("tables"))


CROSS = f"""{LINES},
x AS (SELECT table_id, label_norm, arg_min(value, (row_idx, value)) FILTER (col_idx = 0) AS a, arg_min(value, (row_idx, value)) FILTER (col_idx = 1) AS b, bool_or(col_idx = 0) AS ia, bool_or(col_idx = 1) AS ib FROM lines GROUP BY 1, 2),
n AS (SELECT table_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS compared, count(*) FILTER (abs(a - b) <= greatest(1, 1e-6 * abs(a))) AS agreed FROM x GROUP BY 1 HAVING bool_or(ia) AND bool_or(ib)),
h AS (SELECT *, agreed / nullif(compared, 0) AS rate, CASE WHEN compared = 0 THEN 'none' WHEN agreed = compared THEN '1.00' WHEN agreed / compared >= 0.8 THEN '0.80-0.99' WHEN agreed / compared >= 0.5 THEN '0.50-0.79' ELSE '<0.50' END AS bucket FROM n)"""


def _aliases(spark):
    rows = [("STANDARD", "plain", 0), ("PROMO", "special", 1), ("ECONOMY", "plain", 2), ("LARGE", "size", 3), ("MEDIUM", "size", 4), ("SMALL", "size", 5), ("PROMO", "sale", 6)]
    return spark.createDataFrame(rows, "alias string, concept string, ord int")


def _mapped(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("row_idx"), F.upper(F.split("p_type", " ")[0]).alias("alias"), F.col("p_type").alias("label_norm"), F.col("p_type").alias("label_raw"))
    return joins.by_dictionary(p, _aliases(spark), ["alias"])


MAPPED = "m AS (SELECT p_brand, p_partkey AS row_idx, p_type AS label, CASE upper(split_part(p_type, ' ', 1)) WHEN 'STANDARD' THEN 'plain' WHEN 'PROMO' THEN 'sale' WHEN 'ECONOMY' THEN 'plain' WHEN 'LARGE' THEN 'size' WHEN 'MEDIUM' THEN 'size' WHEN 'SMALL' THEN 'size' END AS concept FROM part)"


def concept_map(spark, sf_dir):
    return _mapped(spark, sf_dir).groupBy("concept").agg(F.count("*").alias("rows"))


def concept_first(spark, sf_dir):
    return S.mapped(_mapped(spark, sf_dir), ["p_brand"])


def duplicate_claims(spark, sf_dir):
    return S.duplicate_claims(_mapped(spark, sf_dir).where("concept is not null"), ["p_brand"]).groupBy("p_brand").agg(F.count("*").alias("claims"))


def concept_coverage(spark, sf_dir):
    wanted = spark.createDataFrame([("plain",), ("sale",), ("size",), ("unknown",)], "concept string")
    rows = _mapped(spark, sf_dir)
    brands = rows.select("p_brand").union(spark.createDataFrame([("a brand without parts",)], "p_brand string"))
    return S.coverage(wanted, rows.where("concept is not null"), ["p_brand"], brands)


def label_divergence(spark, sf_dir):
    return S.divergence(_mapped(spark, sf_dir).where("concept is not null"), "p_brand")


def _pages(spark, sf_dir):
    """Each customer's orders as pages of a table, in order of keys."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)
    strong = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.col("o_orderpriority"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_custkey", page.cast("int").alias("page"), (F.col("o_orderkey") % 3).cast("int").alias("width"), strong.alias("strong"), (F.col("o_orderkey") % 40).alias("rows"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("unit"))


def stitched_segments(spark, sf_dir):
    return S.segments(_pages(spark, sf_dir), ["o_custkey"], 8)


def leading_runners(spark, sf_dir):
    """Lines of an order without its leading rows of one kind."""
    l = table(spark, sf_dir, "lineitem").withColumn("row_idx", F.expr(ROW))
    return S.without_runners(l, ["l_orderkey"], "row_idx", F.col("l_returnflag") == "N").groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.min("l_linenumber").alias("first"))


def chosen_candidates(spark, sf_dir):
    """Per supplier the candidate line of the first good strategy."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 4).alias("strategy"), F.floor(F.col("l_quantity") / 10).cast("int").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("top"))
    return S.short_circuit(l, ["l_suppkey"], "strategy", "score", 3, S.MIN_SCORE)


def rebuilt_lines(spark, sf_dir):
    """Words of conversations placed on a grid, as lines."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("x0", "text"))
    words = c.select("conv_id", (F.col("turn") * 3).cast("double").alias("top"), "x0", "text")
    return S.rebuilt_lines(words, ["conv_id"]).select("conv_id", "line", F.md5("text").alias("digest"))


def _cells(spark, sf_dir):
    """Nations by market segment: every combination, found or not."""
    c = table(spark, sf_dir, "customer")
    facts = c.groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 100).cast("long"))).alias("value"), F.count("*").alias("n")).withColumn("found", F.lit(True))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    segments = c.select("c_mktsegment").distinct()
    cells = joins.product([nations, segments], facts, ["c_nationkey", "c_mktsegment"])
    status, why = S.cell_status(F.coalesce("found", F.lit(False)), F.col("value"), F.col("n") >= 3, F.col("n") % 5 == 0, F.when(F.col("c_nationkey") % 4 != 0, F.lit("元")))
    return cells.withColumns({"status": status, "why": why})


CELLS = """facts AS (SELECT c_nationkey, c_mktsegment, sum(CASE WHEN c_acctbal > 0 THEN round(c_acctbal * 100)::BIGINT END)::BIGINT AS value, count(*) AS n FROM customer GROUP BY 1, 2),
cells AS (SELECT n_name, c_mktsegment, value, CASE WHEN n IS NULL THEN '?' WHEN value IS NULL OR n < 3 OR n % 5 = 0 OR n_nationkey % 4 = 0 THEN '⚠' ELSE '✓' END AS status,
  CASE WHEN n IS NULL THEN 'concept missing' WHEN value IS NULL THEN 'extraction gap' WHEN n < 3 THEN 'no strong label' WHEN n % 5 = 0 THEN 'identity fails' WHEN n_nationkey % 4 = 0 THEN 'unit unknown' ELSE 'ok' END AS why
  FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) LEFT JOIN facts f USING (c_mktsegment) WHERE f.c_nationkey IS NULL OR true)"""
CELLS = CELLS.replace("LEFT JOIN facts f USING (c_mktsegment) WHERE f.c_nationkey IS NULL OR true)", "s LEFT JOIN facts f ON f.c_mktsegment = s.c_mktsegment AND f.c_nationkey = n_nationkey)").replace("SELECT n_name, c_mktsegment,", "SELECT n_name, s.c_mktsegment,")


def trusted_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("n_name", "c_mktsegment", "value", "status", "why")


def status_counts(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("status").agg(F.count("*").alias("cells"))


def comparison(spark, sf_dir):
    """The pivoted table that is published."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out = _cells(spark, sf_dir).groupBy("n_name").pivot("c_mktsegment", names).agg(F.first("status"))
    return out.select("n_name", *[F.col(x).alias(x.lower()) for x in names])


def ratios(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.round("o_totalprice").cast("long"))).alias("part"), F.sum(F.round("o_totalprice").cast("long")).alias("whole"))
    return o.select("o_custkey", F.round(S.ratio(F.col("part"), F.col("whole")), 6).alias("ratio"))


def mutation_caught(spark, sf_dir):
    """Verdicts before and after corruptions: how many tables change. Scaling a
    whole table keeps its identities true; only its unit tells (see scaled_units)."""
    rows = _facts(spark, sf_dir).select("table_id", "concept", F.col("concept").alias("label_norm"), F.array("value").alias("vals"))
    cases = {"bump": mutations.bump("total", 1), "shift": mutations.shift("total", 100), "drop": mutations.drop_row("tax"), "scale": mutations.scale(10, "net"), "scale_all": mutations.scale(10000), "overwrite": mutations.overwrite("total", 1.0)}
    own = ["table_id", "mutation"]
    verdicts = S.verdicts(S.identity_residuals(mutations.copies(rows, cases), _terms(spark), own), own)
    grid = mutations.grid(verdicts.withColumnRenamed("ident", "detector"), ["table_id"], list(cases))
    return grid.groupBy("mutation").agg(F.sum("caught").alias("changed"), F.max("tables").alias("tables"))


def _verdicts(spark, facts):
    return S.verdicts(S.identity_residuals(facts, _terms(spark), ["table_id"]), ["table_id"])


def reversed_columns(spark, sf_dir):
    """Value columns the wrong way round: identities stay true, another document tells."""
    lines = _lines(spark, sf_dir)
    turned = S.reverse_columns(lines, ["table_id"])
    compared = S.cross_document(turned.where("col_idx = 0"), lines.where("col_idx = 0"), ["table_id", "label_norm"], "row_idx")
    return compared.agg(F.count("*").alias("compared"), F.count_if("same").alias("agreed"))


def scaled_units(spark, sf_dir):
    """Tables scaled as a whole, found by their total against the same total elsewhere."""
    facts = _facts(spark, sf_dir).where("concept = 'total'")
    wrong = S.scale_value(facts.withColumn("label_norm", F.col("concept")), 10000)
    compared = S.cross_document(wrong, facts, ["table_id", "concept"], "col_idx")
    return S.agreement(compared, ["concept"])


def merged_concepts(spark, sf_dir):
    """Claims of one concept by several labels, before and after two concepts are merged into one."""
    parts = _mapped(spark, sf_dir).drop("concept")
    before, after = (S.duplicate_claims(joins.by_dictionary(parts, a, ["alias"]).where("concept is not null"), ["p_brand"]).agg(F.count("*").alias("claims")) for a in (_aliases(spark), S.merge_concept(_aliases(spark), "size", "plain")))
    return joins.union([before.select(F.lit("before").alias("aliases"), "claims"), after.select(F.lit("after").alias("aliases"), "claims")])


def dropped_alias(spark, sf_dir):
    """In how many brands an identity of two concepts can be judged, before and after an alias is lost."""
    terms = spark.createDataFrame([("size = sale", "size", -1, False), ("size = sale", "sale", 1, False)], "ident string, concept string, coef int, optional boolean")
    parts = _mapped(spark, sf_dir).drop("concept")
    out = []
    for name, aliases in (("before", _aliases(spark)), ("after", S.drop_alias(_aliases(spark), "PROMO"))):
        facts = joins.by_dictionary(parts, aliases, ["alias"]).where("concept is not null").groupBy("p_brand", "concept").agg(F.count("*").alias("value")).withColumn("col_idx", F.lit(0))
        verdicts = S.verdicts(S.identity_residuals(facts, terms, ["p_brand"]), ["p_brand"])
        out.append(S.judged_rate(verdicts, "size = sale").select(F.lit(name).alias("aliases"), "judged", "tables", "rate"))
    return joins.union(out)


def skip_reasons(spark, sf_dir):
    """Why identities couldn't be judged, with how many tables each reason concerns."""
    detail = S.explained(S.identity_residuals(_facts(spark, sf_dir, True), _terms(spark), ["table_id"]), ["table_id"])
    return S.skip_reasons(detail, "detail", "table_id").select("reason", F.size("members").alias("tables"))


def whole_checks(spark, sf_dir):
    """Required rows, identities and range sums of each table, in total and by check."""
    required = spark.createDataFrame([("assets",), ("debt",)], "name string")
    checks = S.whole_check(_lines(spark, sf_dir, True), _facts(spark, sf_dir, True), required, _terms(spark), [("cash and assets", "equity")], ["table_id"])
    return S.check_totals(checks, ["ident"])


def _statements(spark, sf_dir):
    """Customers of a nation as a company's tables: (member, kind, label_norm, unit)."""
    c = table(spark, sf_dir, "customer")
    kind = F.element_at(F.array(*map(F.lit, ("BS", "IS", "CF"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select(F.col("c_nationkey").alias("member"), kind.alias("kind"), F.col("c_mktsegment").alias("label_norm"), F.when(F.col("c_custkey") % 10 < 8, F.when(F.col("c_nationkey") % 3 == 0, "万元").otherwise("元")).alias("unit"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"), F.col("c_custkey").alias("row_idx"))


STATEMENTS = "st AS (SELECT c_nationkey AS member, ['BS', 'IS', 'CF'][c_custkey % 3 + 1] AS kind, c_mktsegment AS label_norm, CASE WHEN c_custkey % 10 < 8 THEN CASE WHEN c_nationkey % 3 = 0 THEN '万元' ELSE '元' END END AS unit, round(c_acctbal * 100)::BIGINT AS value, c_custkey AS row_idx FROM customer)"
JUDGED = "v AS (SELECT member, kind, 'positive' AS ident, CASE WHEN count(*) < 8 THEN 'skip' WHEN sum(value) > 0 THEN 'pass' ELSE 'fail' END AS verdict FROM st GROUP BY 1, 2)"


def _judged(st):
    return st.groupBy("member", "kind").agg(F.when(F.count("*") < 8, "skip").when(F.sum("value") > 0, "pass").otherwise("fail").alias("verdict")).withColumn("ident", F.lit("positive"))


def table_trust(spark, sf_dir):
    st = _statements(spark, sf_dir)
    strong = spark.createDataFrame([("BUILD",), ("MACHINE",)], "label string")
    return trust.table_trust(st, _judged(st), strong, ["member", "kind"])


TRUST = f"{STATEMENTS}, {JUDGED}, tr AS (SELECT member, kind, bool_or(contains(label_norm, 'BUILD') OR contains(label_norm, 'MACHINE')) AS strong, bool_or(unit IS NOT NULL) AS unit_known, coalesce(any_value(f), false) AS ident_fail FROM st LEFT JOIN (SELECT member, kind, verdict = 'fail' AS f FROM v) USING (member, kind) GROUP BY 1, 2)"


def derived_cells(spark, sf_dir):
    """A ratio of each table whose revenue comes from the preferred concept or the other, with the table's trust."""
    st = _statements(spark, sf_dir)
    of = lambda name: F.sum(F.when(F.col("label_norm") == name, F.col("value")))
    wide = st.groupBy("member", "kind").agg(of("BUILDING").alias("a"), of("MACHINERY").alias("b"), of("FURNITURE").alias("n"))
    r = trust.revenue(F.col("a"), F.col("b"), ("BUILDING", "MACHINERY"))
    cells = wide.join(table_trust(spark, sf_dir), ["member", "kind"]).withColumn("r", r)
    value = S.ratio(F.col("n"), F.col("r.value"))
    status, why = F.when(value.isNull(), "⚠").otherwise("✓"), F.when(value.isNull(), "part missing").otherwise("ok")
    status, why = trust.downgraded(status, why, F.col("strong"), F.col("ident_fail"), F.col("unit_known"))
    return cells.select("member", "kind", F.col("r.basis").alias("basis"), F.round(value, 6).alias("ratio"), status.alias("status"), why.alias("why"))


def scope_gaps(spark, sf_dir):
    """Two concepts of each table, how far apart they are, and why one is missing."""
    st = _statements(spark, sf_dir).groupBy("member", "kind", F.col("label_norm").alias("concept")).agg(F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("value"))
    out = trust.scope_gap(st, ["member", "kind"], "BUILDING", "MACHINERY")
    return out.withColumn("gap_pct", F.round("gap_pct", 6))


def company_bench(spark, sf_dir):
    """Nations as companies, and one of which there is no table."""
    st = _statements(spark, sf_dir)
    members = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("member")).union(spark.range(-1, 0))
    wanted = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NONE",)], "concept string")
    cover = S.coverage(wanted, st.select("member", "kind", F.col("label_norm").alias("concept")), ["member", "kind"])
    return trust.bench(members, st.select("member", "kind").distinct(), cover, _judged(st), "member")


def unit_members(spark, sf_dir):
    return trust.members_by_unit(_statements(spark, sf_dir), "member")


def missing_tables(spark, sf_dir):
    """Statements that a nation has no table of, of the three it files and one that nobody does."""
    have = _statements(spark, sf_dir).select("member", "kind").distinct()
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("member")).crossJoin(spark.createDataFrame([("BS",), ("IS",), ("CF",), ("EQ",)], "kind string"))
    return trust.table_missing(wanted, have, ["member", "kind"])


def label_members(spark, sf_dir):
    """Concepts that brands call by different labels, with each brand's first one."""
    out = S.label_of_member(_mapped(spark, sf_dir).where("concept is not null"), "p_brand")
    return out.select("concept", F.explode("by_member").alias("p_brand", "label"))


def first_values(spark, sf_dir):
    """The first known value of each label of each order."""
    return S.first_values(_lines(spark, sf_dir), ["table_id"])


def _segments(spark, sf_dir):
    """Orders of a customer as segments of pages."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_custkey", F.lit("合并").alias("scope"), k.alias("segment"), (k % 97).cast("int").alias("first_page"), (k % 97 + k % 4).cast("int").alias("last_page"), (k % 40).alias("rows"), (k % 3 == 0).alias("has_strong"), (k % 11 == 0).alias("conflict"))


def adopted_segments(spark, sf_dir):
    """The main segment of each customer and its extra copies."""
    return segmenting.adopted(_segments(spark, sf_dir), ["o_custkey"], "scope").select("o_custkey", "segment", "rank", "copy", "scope")


def cropped_choice(spark, sf_dir):
    """Candidates of each supplier's cropped page, or of the whole one if its best is better."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(ROW).alias("row_idx"), F.col("l_orderkey"), (F.col("l_linenumber") % 2 == 0).alias("cropped"), F.floor(F.col("l_quantity")).cast("int").alias("score"))
    return segmenting.cropped_or_raw(l, ["l_suppkey"], "score", "cropped").groupBy("l_suppkey", "cropped").agg(F.count("*").alias("candidates"), F.max("score").alias("best"))


def paired_choice(spark, sf_dir):
    """Of each order's lines in two versions the better one; version 1 wins ties."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("version")).agg(F.floor(F.max("l_quantity")).cast("int").alias("score"))
    return joins.pairwise(l, ["l_orderkey"], F.col("version"), F.col("score"))


def longest_tables(spark, sf_dir):
    """Of each customer and status the order with the most lines, if it has five or more, and its widest line."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.collect_list(F.array_repeat(F.lit(0), (F.col("l_linenumber") % 5).cast("int"))).alias("rows"))
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    best = joins.largest(o, ["o_custkey", "o_orderstatus"], F.col("lines"), 5, "o_orderkey")
    return best.select("o_custkey", "o_orderstatus", "o_orderkey", "lines", segmenting.width(F.col("rows")).alias("width"))


def gated_pages(spark, sf_dir):
    """Pages (orders) of each kind that hold a word of their own statement and lie within the band."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("BS", "IS", "CF"))), (k % 3 + 1).cast("int"))
    word = F.element_at(F.array(*map(F.lit, ("资产总计", "净利润合计", "附注", "现金及现金等价物余额"))), (k % 4 + 1).cast("int"))
    pages = o.select(kind.alias("kind"), F.array(F.array(F.lit("项目"), F.lit(None).cast("string")), F.array(word, F.lit("1"))).alias("rows"), (k % 900).alias("top"))
    return pages.where(segmenting.in_band(F.col("top"))).groupBy("kind").agg(F.count("*").alias("pages"), F.count_if(segmenting.gate(F.col("rows"), F.col("kind"))).alias("gated"))


def page_sets(spark, sf_dir):
    """Distinct suppliers of each order, in order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("p"))
    return l.select("l_orderkey", segmenting.page_list(F.col("p")).alias("pages"))


def worst_pages(spark, sf_dir):
    """The eight tables on which two columns agree least."""
    return diagnosis.worst_pages(cross_document(spark, sf_dir), 8, 0.8, "table_id").select("table_id", "rate")


def conflicts(spark, sf_dir):
    """Customers most of whose orders disagree between their two columns."""
    per = cross_document(spark, sf_dir).withColumn("compared", F.col("compared") + 3).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), "o_custkey"), "table_id")
    return S.conflicts(per, ["o_custkey"])


def largest_differences(spark, sf_dir):
    """The largest differences of each order's two columns, eight at most."""
    lines = _lines(spark, sf_dir)
    compared = S.cross_document(lines.where("col_idx = 0"), lines.where("col_idx = 1"), ["table_id", "label_norm"], "row_idx")
    out = S.different(compared, ["table_id"])
    return out.select("table_id", F.size("differences").alias("n"), F.get("differences", F.lit(0))["gap"].alias("worst"))


def amounts(spark, sf_dir):
    """Amounts written out and read back, in their unit and in the base unit."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    shown = T.amount(cents.cast("decimal(18,2)") / 100)
    cell = F.when(k % 5 == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(k % 5 == 1, "—").when(k % 5 == 2, "不适用").otherwise(shown)
    unit = T.unit(F.when(k % 3 == 0, "金额单位为人民币百万元").when(k % 3 == 1, "单位：元").otherwise("无"))
    base = o.select("o_orderkey", T.to_number(cell).alias("value"), unit.alias("u"))
    return base.select("o_orderkey", "value", T.in_base_unit(F.col("value"), F.col("u"))["unit"].alias("unit"), F.round(T.in_base_unit(F.col("value"), F.col("u"))["value"], 2).alias("base_value"))


def cleaned_rows(spark, sf_dir):
    """Rows of cells with header and blank rows, cleaned to labels and values."""
    l = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") % 4
    text = lambda c: c.cast("int").cast("string")
    cells = F.when(n == 0, F.array(F.lit("项 目"), F.lit("2023年"))).when(n == 1, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.concat(F.lit("a\n"), F.col("l_returnflag")), F.lit("—"), text(F.col("l_quantity")), text(F.col("l_suppkey"))))
    out = S.clean_rows(l.select("l_orderkey", cells.alias("cells")), "cells")
    return out.groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.min("label").alias("label"), F.sum(A.first_value(F.col("vals"))).alias("first"), F.sum(A.value_at(F.col("vals"), F.lit(2))).alias("third"), F.count(A.value_at(F.col("vals"), F.lit(7))).alias("beyond"))


def column_shapes(spark, sf_dir):
    """What the first strategy that found a table found on each page."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_linenumber") % 3).alias("strategy")).agg(F.min("l_returnflag").alias("m"), F.count("*").alias("n"))
    rows = F.when(F.col("n") % 2 == 0, F.array(F.array("m", F.lit("a header that is longer than sixteen")), F.array(F.col("n").cast("string"), F.lit("a cell longer than fourteen")))).otherwise(F.array().cast("array<array<string>>"))
    return diagnosis.column_shapes(l.select("l_suppkey", "strategy", rows.alias("rows")), ["l_suppkey"])


QUERIES = {f.__name__: f for f in (
    column_profiles, identity_verdicts, verdict_counts, range_sums, range_sums_loose, missing_rows, fuzzy_rows, cross_document, agreement_histogram, concept_map, concept_first, duplicate_claims, concept_coverage,
    label_divergence, label_members, first_values, skip_reasons, whole_checks, table_trust, derived_cells, scope_gaps, company_bench, unit_members, missing_tables, adopted_segments, cropped_choice, paired_choice,
    longest_tables, gated_pages, page_sets, worst_pages, conflicts, largest_differences, amounts, cleaned_rows, column_shapes, reversed_columns, scaled_units, merged_concepts, dropped_alias, stitched_segments, leading_runners, chosen_candidates, rebuilt_lines, trusted_cells, status_counts, comparison, ratios, mutation_caught,
)}

ORACLES = {
    "column_profiles": f"""WITH {LINES}, p AS (SELECT table_id, col_idx, count(value) AS filled, count(*) AS cells, coalesce(bool_and(abs(value) < 1000), false) AS small FROM lines GROUP BY 1, 2),
q AS (SELECT *, max(cells) OVER (PARTITION BY table_id) AS rows FROM p), e AS (SELECT *, filled >= greatest(2, 0.5 * rows) AS enough FROM q), n AS (SELECT *, small AND enough AS is_note FROM e),
k AS (SELECT *, bool_or(enough AND NOT is_note) OVER (PARTITION BY table_id) AS any_kept FROM n)
SELECT table_id, col_idx, filled, rows, is_note, NOT is_note AND CASE WHEN any_kept THEN enough ELSE filled > 0 END AS kept FROM k""",
    "identity_verdicts": f"WITH {FACTS} SELECT * FROM verdicts",
    "verdict_counts": f"WITH {FACTS} SELECT verdict, count(*) AS n FROM verdicts GROUP BY 1",
    "range_sums": range_sql("label_norm = 'cash and assets'", "equity"),
    "range_sums_loose": range_sql("contains(label_norm, 'assets')", "debt"),
    "missing_rows": f"WITH {LINES}, x AS (SELECT table_id, name, bool_or(contains(label_norm, name)) AS f FROM lines, (SELECT unnest(['assets', 'debt', 'equity']) AS name) GROUP BY 1, 2) SELECT table_id, coalesce(list(name ORDER BY name) FILTER (NOT f), []) AS missing FROM x GROUP BY 1",
    "fuzzy_rows": f"WITH {LINES}, s AS (SELECT * FROM (VALUES ('a', 'assets'), ('e', 'equity')) t(slot, name)) SELECT table_id, slot, row_idx, value FROM lines JOIN s ON contains(label_norm, name) WHERE col_idx = 0 QUALIFY row_number() OVER (PARTITION BY table_id, slot ORDER BY label_norm = name DESC, length(label_norm), row_idx, value) = 1",
    "cross_document": f"WITH {CROSS} SELECT * FROM h",
    "agreement_histogram": f"WITH {CROSS} SELECT bucket, count(*) AS tables FROM h GROUP BY 1",
    "concept_map": f"WITH {MAPPED} SELECT concept, count(*) AS rows FROM m GROUP BY 1",
    "concept_first": f"WITH {MAPPED} SELECT p_brand, concept, min(row_idx) AS row_idx, arg_min(label, row_idx) AS label_norm FROM m WHERE concept IS NOT NULL GROUP BY 1, 2",
    "duplicate_claims": f"WITH {MAPPED}, f AS (SELECT p_brand, concept, min(row_idx) AS lo, arg_min(label, row_idx) AS l FROM m WHERE concept IS NOT NULL GROUP BY 1, 2) SELECT p_brand, count(*) AS claims FROM m JOIN f USING (p_brand, concept) WHERE row_idx > lo AND label <> l GROUP BY 1",
    "concept_coverage": f"WITH {MAPPED}, w AS (SELECT unnest(['plain', 'sale', 'size', 'unknown']) AS concept), g AS (SELECT DISTINCT p_brand FROM m UNION ALL SELECT 'a brand without parts'), h AS (SELECT DISTINCT p_brand, concept, true AS hit FROM m WHERE concept IS NOT NULL) SELECT p_brand, count(hit) AS hits, count(*) AS total, coalesce(list(concept ORDER BY concept) FILTER (hit IS NULL), []) AS missing FROM g CROSS JOIN w LEFT JOIN h USING (p_brand, concept) GROUP BY 1",
    "label_divergence": f"WITH {MAPPED} SELECT concept, count(DISTINCT label) AS labels, count(DISTINCT p_brand) AS members FROM m WHERE concept IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1",
    "stitched_segments": """WITH RECURSIVE o AS (SELECT o_custkey AS k, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + (o_orderkey % 11 = 0)::INT)::INT AS page, (o_orderkey % 3)::INT AS width, CASE WHEN o_orderkey % 4 = 0 THEN [o_orderpriority] ELSE []::VARCHAR[] END AS strong, o_orderkey % 40 AS rows, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS unit FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page, width, strong, rows, unit NULLS FIRST) AS i FROM o),
r AS (SELECT k, i, 0 AS segment, page AS first_page, page AS last_page, 1 AS pages, width, strong AS seen, rows, unit FROM p WHERE i = 1
  UNION ALL SELECT k, i, segment + fresh::INT, CASE WHEN fresh THEN page ELSE first_page END, page, CASE WHEN fresh THEN 1 ELSE pages + 1 END, CASE WHEN fresh OR old = 0 THEN width ELSE old END, CASE WHEN fresh THEN strong ELSE list_distinct(list_concat(seen, strong)) END, CASE WHEN fresh THEN rows ELSE total + rows END, CASE WHEN fresh THEN unit ELSE coalesce(held, unit) END
  FROM (SELECT p.*, r.segment, r.first_page, r.pages, r.width AS old, r.seen, r.rows AS total, r.unit AS held, p.page <> r.last_page + 1 OR r.pages >= 8 OR (p.width > 0 AND r.width > 0 AND p.width <> r.width) OR list_has_any(p.strong, r.seen) AS fresh FROM r JOIN p ON p.k = r.k AND p.i = r.i + 1))
SELECT k AS o_custkey, segment, first_page, last_page, pages, rows, unit FROM r QUALIFY row_number() OVER (PARTITION BY k, segment ORDER BY i DESC) = 1""",
    "leading_runners": "WITH x AS (SELECT *, sum((l_returnflag <> 'N')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS b FROM lineitem) SELECT l_orderkey, count(*) AS rows, min(l_linenumber) AS first FROM x WHERE b > 0 GROUP BY 1",
    "chosen_candidates": "WITH l AS (SELECT l_suppkey, l_linenumber % 4 AS strategy, floor(l_quantity / 10)::INT AS score, l_orderkey * 10 + l_linenumber AS top FROM lineitem WHERE floor(l_quantity / 10) >= 2), s AS (SELECT *, min(strategy) FILTER (score >= 3) OVER (PARTITION BY l_suppkey) AS stop FROM l) SELECT l_suppkey, strategy, score, top FROM s WHERE stop IS NULL OR strategy <= stop QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, top, strategy) = 1",
    "rebuilt_lines": "SELECT conv_id, turn AS line, md5(string_agg(replace(text, ' ', ''), '' ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2",
    "trusted_cells": f"WITH {CELLS} SELECT * FROM cells",
    "status_counts": f"WITH {CELLS} SELECT status, count(*) AS cells FROM cells GROUP BY 1",
    "comparison": f"WITH {CELLS} SELECT n_name, " + ", ".join(f"max(status) FILTER (c_mktsegment = '{x}') AS {x.lower()}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM cells GROUP BY 1",
    "ratios": "SELECT o_custkey, round(100 * sum(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice)::BIGINT END) / nullif(sum(round(o_totalprice)::BIGINT), 0), 6) AS ratio FROM orders GROUP BY 1",
    "mutation_caught": f"""WITH {FACTS}, c AS (SELECT unnest(['bump', 'shift', 'drop', 'scale', 'scale_all', 'overwrite']) AS mutation),
x AS (SELECT mutation, f.table_id, CASE mutation WHEN 'bump' THEN total + 1 WHEN 'shift' THEN total + 100 WHEN 'overwrite' THEN 1 WHEN 'scale_all' THEN 10000 * total ELSE total END AS t, CASE mutation WHEN 'scale' THEN 10 * net WHEN 'scale_all' THEN 10000 * net ELSE net END AS n,
  CASE mutation WHEN 'drop' THEN NULL WHEN 'scale_all' THEN 10000 * tax ELSE tax END AS tx, CASE mutation WHEN 'scale_all' THEN 10000 * off ELSE off END AS o, verdict AS before FROM f JOIN verdicts USING (table_id), c)
SELECT mutation, count(*) FILTER (before <> CASE WHEN tx IS NULL THEN 'skip' WHEN abs(t - n - tx + coalesce(o, 0)) <= 0.02 THEN 'pass' ELSE 'fail' END) AS changed, count(*) AS tables FROM x GROUP BY 1""",
    "reversed_columns": f"WITH {LINES}, r AS (SELECT table_id, label_norm, arg_min_null(value, row_idx) AS b FROM lines WHERE col_idx = 0 GROUP BY 1, 2) SELECT count(*) AS compared, count(*) FILTER (abs(value - b) <= greatest(1, 1e-6 * abs(value))) AS agreed FROM lines JOIN r USING (table_id, label_norm) WHERE col_idx = 1 AND value IS NOT NULL AND b IS NOT NULL",
    "scaled_units": f"WITH {FACTS} SELECT 'total' AS concept, count(*) AS compared, count(*) FILTER (abs(9999 * total) <= greatest(1, 1e-2 * abs(total))) AS agreed, count(*) FILTER (abs(9999 * total) <= greatest(1, 1e-2 * abs(total))) / count(*) AS rate FROM f",
    "merged_concepts": f"WITH {MAPPED}, x AS (SELECT 'before' AS aliases, * FROM m UNION ALL SELECT 'after', p_brand, row_idx, label, CASE concept WHEN 'size' THEN 'plain' ELSE concept END FROM m), f AS (SELECT aliases, p_brand, concept, min(row_idx) AS lo, arg_min(label, row_idx) AS l FROM x WHERE concept IS NOT NULL GROUP BY ALL) SELECT aliases, count(*) AS claims FROM x JOIN f USING (aliases, p_brand, concept) WHERE row_idx > lo AND label <> l GROUP BY 1",
    "dropped_alias": f"WITH {MAPPED}, b AS (SELECT p_brand, bool_or(concept = 'size') AND bool_or(concept = 'sale') AS j, bool_or(concept <> 'sale') AS rest FROM m WHERE concept IS NOT NULL GROUP BY 1) SELECT 'before' AS aliases, count(*) FILTER (j) AS judged, count(*) AS tables, count(*) FILTER (j) / count(*) AS rate FROM b UNION ALL SELECT 'after', 0, count(*), 0 FROM b WHERE rest",
    "skip_reasons": f"WITH {FACTS} SELECT 'missing tax' AS reason, count(*) AS tables FROM verdicts WHERE verdict = 'skip'",
    "whole_checks": f"""WITH {LINES}, {FACTS}, q AS (SELECT 'required rows' AS ident, CASE WHEN bool_or(contains(label_norm, 'assets')) AND bool_or(label_norm = 'debt') THEN 'pass' ELSE 'fail' END AS verdict FROM lines GROUP BY table_id),
m AS (SELECT *, min(row_idx) FILTER (label_norm = 'cash and assets') OVER (PARTITION BY table_id) AS lo, min(row_idx) FILTER (label_norm = 'equity') OVER (PARTITION BY table_id) AS hi FROM lines),
ro AS (SELECT table_id, col_idx, sum(value) FILTER (row_idx > lo AND row_idx < hi AND NOT contains(label_raw, '其中')) AS o, max(value) FILTER (row_idx = hi) AS t FROM m GROUP BY 1, 2),
rs AS (SELECT table_id, CASE WHEN bool_or(o IS NOT NULL) OVER (PARTITION BY table_id) THEN coalesce(o, 0) END AS i, t FROM ro),
rv AS (SELECT 'cash and assets to equity' AS ident, CASE WHEN bool_or(abs(i - t) > 0.02) THEN 'fail' WHEN bool_or(abs(i - t) <= 0.02) THEN 'pass' ELSE 'skip' END AS verdict FROM rs GROUP BY table_id),
a AS (SELECT ident, verdict FROM q UNION ALL SELECT ident, verdict FROM verdicts UNION ALL SELECT ident, verdict FROM rv)
SELECT ident, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (verdict = 'skip') AS skipped, count(*) FILTER (verdict = 'pass') / nullif(count(*) FILTER (verdict <> 'skip'), 0) AS pass_rate FROM a GROUP BY ROLLUP (ident)""",
    "table_trust": f"WITH {TRUST} SELECT member, kind, strong, unit_known, ident_fail FROM tr",
    "derived_cells": f"""WITH {TRUST}, w AS (SELECT member, kind, sum(value) FILTER (label_norm = 'BUILDING') AS a, sum(value) FILTER (label_norm = 'MACHINERY') AS b, sum(value) FILTER (label_norm = 'FURNITURE') AS n FROM st GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN a IS NOT NULL THEN 'BUILDING' WHEN b IS NOT NULL THEN 'MACHINERY' END AS basis, 100 * n / nullif(coalesce(a, b), 0) AS ratio FROM w JOIN tr USING (member, kind))
SELECT member, kind, basis, round(ratio, 6) AS ratio, CASE WHEN ratio IS NULL OR NOT strong OR ident_fail OR NOT unit_known THEN '⚠' ELSE '✓' END AS status,
  CASE WHEN ratio IS NULL THEN 'part missing' WHEN NOT strong THEN 'no strong label' WHEN ident_fail THEN 'identity fails' WHEN NOT unit_known THEN 'unit unknown' ELSE 'ok' END AS why FROM r""",
    "scope_gaps": f"""WITH {STATEMENTS}, w AS (SELECT member, kind, sum(value) FILTER (label_norm = 'BUILDING' AND value > 0)::BIGINT AS value_a, sum(value) FILTER (label_norm = 'MACHINERY' AND value > 0)::BIGINT AS value_b, count(*) FILTER (label_norm = 'BUILDING') AS na, count(*) FILTER (label_norm = 'MACHINERY') AS nb FROM st GROUP BY 1, 2)
SELECT member, kind, value_a, value_b, value_a - value_b AS gap, round(100 * (value_a - value_b) / nullif(value_b, 0), 6) AS gap_pct,
  nullif(concat_ws('; ', CASE WHEN value_a IS NULL THEN CASE WHEN na = 0 THEN 'BUILDING: no row' ELSE 'BUILDING: no value' END END, CASE WHEN value_b IS NULL THEN CASE WHEN nb = 0 THEN 'MACHINERY: no row' ELSE 'MACHINERY: no value' END END), '') AS why FROM w""",
    "company_bench": f"""WITH {STATEMENTS}, {JUDGED}, c AS (SELECT member, kind, (bool_or(label_norm = 'BUILDING'))::INT + (bool_or(label_norm = 'MACHINERY'))::INT AS hits FROM st GROUP BY 1, 2),
w AS (SELECT n_nationkey AS member, count(kind) AS present, 3 - count(kind) AS absent, coalesce(sum(hits), 0)::BIGINT AS hits, 3 * count(kind) AS wanted, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (verdict = 'skip') AS skipped
  FROM (SELECT n_nationkey FROM nation UNION ALL SELECT -1) LEFT JOIN (SELECT * FROM c JOIN v USING (member, kind)) t ON t.member = n_nationkey GROUP BY 1)
SELECT member, sum(present)::BIGINT AS present, sum(absent)::BIGINT AS absent, sum(hits)::BIGINT AS hits, sum(wanted)::BIGINT AS wanted, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, sum(skipped)::BIGINT AS skipped, sum(passed) / nullif(sum(passed) + sum(failed), 0) AS pass_rate FROM w GROUP BY ROLLUP (member)""",
    "unit_members": f"WITH {STATEMENTS} SELECT coalesce(unit, '?') AS unit, list(DISTINCT member ORDER BY member) AS members FROM st GROUP BY 1",
    "missing_tables": f"WITH {STATEMENTS} SELECT n_nationkey AS member, kind, '?' AS status, 'no table ' || kind AS why FROM nation CROSS JOIN (SELECT unnest(['BS', 'IS', 'CF', 'EQ']) AS kind) k ANTI JOIN (SELECT DISTINCT member, kind FROM st) h ON n_nationkey = h.member AND k.kind = h.kind",
    "label_members": f"WITH {MAPPED}, f AS (SELECT concept, p_brand, arg_min(label, row_idx) AS label FROM m WHERE concept IS NOT NULL GROUP BY 1, 2) SELECT concept, p_brand, label FROM f WHERE concept IN (SELECT concept FROM f GROUP BY 1 HAVING count(DISTINCT label) > 1)",
    "first_values": f"WITH {LINES} SELECT table_id, label_norm, arg_min(value, (row_idx, col_idx, value)) AS value FROM lines WHERE value IS NOT NULL GROUP BY 1, 2",
    "adopted_segments": """WITH s AS (SELECT o_custkey, o_orderkey AS segment, o_orderkey % 97 AS fp, o_orderkey % 97 + o_orderkey % 4 AS lp, o_orderkey % 40 AS rows, o_orderkey % 3 = 0 AS st, o_orderkey % 11 = 0 AS cf FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY cf, st DESC, rows DESC, fp, segment) AS rank FROM s),
m AS (SELECT o_custkey, rows AS mr, lp AS me FROM r WHERE rank = 1 AND NOT cf AND rows >= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rank) AS copy FROM r JOIN m USING (o_custkey) WHERE rank = 1 OR (rows >= greatest(8, mr // 2) AND fp <= me + 6))
SELECT o_custkey, segment, rank, copy, CASE WHEN copy = 1 THEN '合并' ELSE '合并#' || copy END AS scope FROM k""",
    "cropped_choice": "WITH l AS (SELECT l_suppkey, l_linenumber % 2 = 0 AS cropped, floor(l_quantity)::INT AS score FROM lineitem), b AS (SELECT l_suppkey, max(score) FILTER (cropped) AS c, max(score) FILTER (NOT cropped) AS r FROM l GROUP BY 1) SELECT l_suppkey, cropped, count(*) AS candidates, max(score) AS best FROM l JOIN b USING (l_suppkey) WHERE cropped = (c IS NOT NULL AND (r IS NULL OR c >= r)) GROUP BY 1, 2",
    "paired_choice": "WITH l AS (SELECT l_orderkey, l_linenumber % 2 AS version, floor(max(l_quantity))::INT AS score FROM lineitem GROUP BY 1, 2) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, version DESC) = 1",
    "longest_tables": "WITH l AS (SELECT l_orderkey, count(*) AS lines, max(l_linenumber % 5) AS width FROM lineitem GROUP BY 1) SELECT o_custkey, o_orderstatus, o_orderkey, lines, width FROM orders JOIN l ON o_orderkey = l_orderkey WHERE lines >= 5 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY lines DESC, o_orderkey) = 1",
    "gated_pages": "WITH p AS (SELECT ['BS', 'IS', 'CF'][o_orderkey % 3 + 1] AS kind, o_orderkey % 4 AS w FROM orders WHERE o_orderkey % 900 BETWEEN 115 AND 740) SELECT kind, count(*) AS pages, count(*) FILTER ((kind = 'BS' AND w = 0) OR (kind = 'IS' AND w = 1) OR (kind = 'CF' AND w = 3)) AS gated FROM p GROUP BY 1",
    "page_sets": "SELECT l_orderkey, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS pages FROM lineitem GROUP BY 1",
    "worst_pages": f"WITH {CROSS} SELECT table_id, rate FROM h WHERE rate < 0.8 ORDER BY rate, table_id LIMIT 8",
    "conflicts": f"WITH {CROSS}, p AS (SELECT o_custkey, count(*) AS pages, count(*) FILTER (compared + 3 >= 5 AND rate < 0.8) AS bad FROM h JOIN orders ON o_orderkey = table_id GROUP BY 1) SELECT *, bad >= greatest(1, pages // 2) AS conflict FROM p",
    "largest_differences": f"WITH {LINES}, r AS (SELECT table_id, label_norm, arg_min_null(value, row_idx) AS b FROM lines WHERE col_idx = 1 GROUP BY 1, 2), c AS (SELECT table_id, abs(value - b) AS gap FROM lines JOIN r USING (table_id, label_norm) WHERE col_idx = 0 AND abs(value - b) > greatest(1, 1e-6 * abs(value))) SELECT table_id, least(count(*), 8) AS n, -max(gap) AS worst FROM c GROUP BY 1",
    "amounts": "WITH o AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT / 100 AS x FROM orders), v AS (SELECT k, CASE WHEN k % 5 = 0 THEN -x WHEN k % 5 > 2 THEN x END AS value FROM o) SELECT k AS o_orderkey, value, CASE k % 3 WHEN 0 THEN '百万元' WHEN 1 THEN '元' ELSE '?' END AS unit, round(value * CASE WHEN k % 3 = 0 THEN 1e6 ELSE 1 END, 2) AS base_value FROM v",
    "cleaned_rows": "SELECT l_orderkey, count(*) AS rows, min('a ' || l_returnflag) AS label, sum(l_quantity::INT)::DOUBLE AS first, sum(l_suppkey)::DOUBLE AS third, 0 AS beyond FROM lineitem WHERE l_linenumber % 4 > 1 GROUP BY 1",
    "column_shapes": "WITH l AS (SELECT l_suppkey, l_linenumber % 3 AS strategy, min(l_returnflag) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT *, min(strategy) OVER (PARTITION BY l_suppkey) AS lo FROM l WHERE n % 2 = 0) SELECT l_suppkey, strategy, 2 AS columns, [substr(m, 1, 16), 'a header that is'] AS header, [n::VARCHAR, 'a cell longer '] AS second FROM f WHERE strategy = lo",
}
