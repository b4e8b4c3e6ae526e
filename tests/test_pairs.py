"""Documents against each other, corruptions against all checks, and groups that have nothing."""

import random

from pyspark.sql import functions as F

from plumbline.operators import crossdoc, mutations, trust
from plumbline.operators import statements as S
from plumbline.sources import readers

TABLES = {
    "2023FY": (["项目", "2023年12月31日", "2022年12月31日"], [("货币资金", 10.0, 8.0), ("其中：存款", 4.0, None), ("资产总计", 100.0, 90.0), ("资产总计", 7.0, 7.0), ("", 1.0, 1.0)]),
    "2024Q1": (["项目", "2024年3月31日", "2023年12月31日"], [("一、货币资金", 11.0, 10.01), ("存款", 5.0, 4.0), ("资产总计：", 120.0, 99.0), ("其他", 3.0, 2.0)]),
    "2024Q3": (["项目", "2024年9月30日", "2023 年12月31日"], [("货币资金", 12.0, 10.5), ("资产总计", 130.0, None)]),
    "other": (["项目", "2021年12月31日", None], [("货币资金", 1.0, 2.0)]),
}


def cells(spark, turned=False):
    rows = [(d, "BS", "合并", "甲", [], h, [(label, list(reversed(v)) if turned else list(v)) for label, *v in own], "元") for d, (h, own) in TABLES.items()]
    t = spark.createDataFrame(rows, "file string, label string, scope string, symbol string, pages array<int>, header array<string>, rows array<struct<label string, vals array<double>>>, unit string")
    return readers.statement_lines(t.withColumn("period", F.col("file")))


def test_pairs_share_dates(spark, monkeypatch):
    facts = crossdoc.dated_facts(cells(spark), ["symbol", "stmt"], "file")
    want = {("2023FY", "2024Q1"): (4, 2, [("资产总计", 100.0, 99.0), ("资产总计", 7.0, 99.0)]), ("2023FY", "2024Q3"): (1, 0, [("货币资金", 10.0, 10.5)]), ("2024Q1", "2024Q3"): (1, 0, [("货币资金", 10.01, 10.5)])}
    for hot, salts in ((10_000, 64), (0, 3)):
        monkeypatch.setattr(crossdoc, "HOT", hot)
        monkeypatch.setattr(crossdoc, "SALTS", salts)
        got = {(r.doc_a, r.doc_b): (r.compared, r.same, [tuple(d) for d in r.differences]) for r in crossdoc.pairs(facts, ["symbol", "stmt"]).collect()}
        assert got == want
    turned = crossdoc.pairs(crossdoc.dated_facts(cells(spark, True), ["symbol", "stmt"], "file"), ["symbol", "stmt"], facts).where("doc_a <> doc_b").agg(F.sum("compared").alias("n"), F.sum("same").alias("same")).first()
    assert turned.same == 0 and turned.n > 5


def test_corruptions_against_checks(spark):
    rows = spark.createDataFrame([(1, 0, "items", None, [None, None]), (1, 1, "a", None, [3.0, 2.0]), (1, 2, "b", None, [4.0, 2.0]), (1, 3, "sum", "sum", [7.0, 4.0]), (1, 4, "tax", "tax", [1.0, None]), (1, 5, "whole", "whole", [8.0, 5.0])], "t int, row_idx int, label_norm string, concept string, vals array<double>").withColumn("label_raw", F.col("label_norm"))
    cases = {"drop": mutations.drop_row("whole"), "bump": mutations.bump("sum", 1), "scale": mutations.scale(10, "tax"), "all": mutations.scale(10000), "turn": mutations.reverse(), "set": mutations.overwrite("whole", 1.0)}
    head = lambda df: df.withColumn("header_text", F.concat(F.lit("d"), F.col("col_idx").cast("string")))
    lines = head(mutations.copies(rows, cases))
    assert lines.count() == 7 * 12 - 2
    other = head(rows.select("*", F.posexplode("vals").alias("col_idx", "value")).drop("vals"))
    terms = spark.createDataFrame([("i", "whole", -1, False), ("i", "sum", 1, False), ("i", "tax", 1, False)], "ident string, concept string, coef int, optional boolean")
    found = mutations.detected(lines, other, ["t"], terms, spark.createDataFrame([("whole",)], "name string"), [("items", "sum")])
    caught = {(r.mutation, r.detector) for r in mutations.grid(found, ["t"]).where("caught > 0").collect()}
    assert caught == {("drop", "required rows"), ("drop", "i"), ("bump", "i"), ("bump", "items to sum"), ("bump", "other document"), ("scale", "i"), ("scale", "other document"), ("all", "other document"), ("turn", "other document"), ("set", "i"), ("set", "other document")}
    assert mutations.grid(found, ["t"]).count() == 6 * 4


def test_groups_without_anything_keep_a_row(spark):
    lines = spark.createDataFrame([(1, 0, "start", "start", 0, None), (1, 1, "x", "x", 0, 5), (1, 1, "x", "x", 1, None), (1, 2, "end", "end", 0, 5), (1, 2, "end", "end", 1, 7), (2, 0, "start", "start", 0, None), (2, 2, "end", "end", 0, 7)], "t int, row_idx int, label_norm string, label_raw string, col_idx int, value long")
    assert sorted((r.t, r.col_idx, r.inner_sum, r.verdict) for r in S.range_sums(lines, ["t"], "start", "end").collect() if r.stated is not None) == [(1, 0, 5, "pass"), (1, 1, 0, "fail"), (2, 0, None, "skip")]
    one = spark.createDataFrame([(1, "a", 0, 0, 5), (2, "a", 0, 0, 5), (3, "a", 0, 0, 5)], "p int, label_norm string, row_idx int, col_idx int, value long")
    two = spark.createDataFrame([(1, "a", 0, 0, None), (1, "a", 1, 0, 5), (1, "a", 2, 0, 9), (2, "b", 0, 0, 5)], "p int, label_norm string, row_idx int, col_idx int, value long")
    got = {r.p: (r.compared, r.agreed, r.rate, r.bucket) for r in S.dual_agreement(one, two, ["p"]).withColumn("bucket", S.agreement_bucket(F.col("rate"))).collect()}
    assert got == {1: (1, 1, 1.0, "1.00"), 2: (0, 0, None, "none")}
    wanted = spark.createDataFrame([("c",)], "concept string")
    members = spark.createDataFrame([(1,), (2,)], "m int")
    cover = S.coverage(wanted, spark.createDataFrame([(1, "c")], "m int, concept string"), ["m"], members)
    assert {r.m: (r.hits, r.total, r.missing) for r in cover.collect()} == {1: (1, 1, []), 2: (0, 1, ["c"])}
    total = trust.bench(members, spark.createDataFrame([(1, "BS")], "m int, kind string"), cover, spark.createDataFrame([(1, "pass")], "m int, verdict string"), "m")
    assert {r.m: (r.present, r.absent, r.hits, r.wanted, r.passed) for r in total.collect()} == {1: (1, 2, 1, 1, 1), 2: (0, 3, 0, 1, 0), None: (1, 5, 1, 2, 1)}


def test_copies_are_not_shuffled(spark):
    """Rows go by table once; what checks copies and counts them for each table stays there."""
    rows = spark.range(40).select((F.col("id") % 5).alias("t"), F.col("id").alias("row_idx"), F.lit("whole").alias("label_norm"), F.lit("whole").alias("label_raw"), F.lit("whole").alias("concept"), F.array(F.col("id").cast("double")).alias("vals"))
    dealt = mutations.dealt(rows, ["t"], 2)
    lines = mutations.copies(dealt, {"scale": mutations.scale(10)}).withColumn("header_text", F.lit("d1"))
    other = dealt.select("t", "row_idx", "label_norm", "label_raw", "concept", F.posexplode("vals").alias("col_idx", "value")).withColumn("header_text", F.lit("d1"))
    terms = spark.createDataFrame([("i", "whole", -1, False)], "ident string, concept string, coef int, optional boolean")
    found = mutations.detected(lines, other, ["t"], terms, spark.createDataFrame([("whole",)], "name string"), [("items", "sum")])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "SortMergeJoin" not in plan  # small sides only
    own = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in own.splitlines() if "Exchange hashpartitioning" in line and "mutation" in line]
    assert not moved


def test_terms_beyond_one_word(spark):
    """Of more required terms than a number has bits, those that are missing are named."""
    names = [f"c{k:03}" for k in range(150)]
    terms = spark.createDataFrame([("i", n, 1, False) for n in names], "ident string, concept string, coef int, optional boolean")
    lines = spark.createDataFrame([(1, n, 0, 1) for n in names if n not in ("c000", "c061", "c062", "c124", "c149")], "t int, concept string, col_idx int, value long")
    r = S.identity_residuals(lines, terms, ["t"]).first()
    assert (r.residual, r.missing, r.absent) == (-145, 5, ["c000", "c061", "c062", "c124", "c149"])


def test_corruptions_of_facts_read_tables_once(spark):
    from plumbline.plans import statements

    plan = statements.mutation_caught(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan


def test_ranges_sort_no_labels(spark):
    """What is sorted by table says of a label whether it begins or ends a range, without the label."""
    lines = spark.range(9).select(F.col("id").alias("t"), F.col("id").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("id").alias("value"), *[F.concat(F.lit("label"), F.col("id").cast("string")).alias(c) for c in ("label_norm", "label_raw")])
    plan = S.range_sums(lines, ["t"], "label1", "label3")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.rindex("Window ") :].splitlines()[1]
    assert "Project" in window and " AS label_raw" not in window and " AS label_norm" not in window


def test_total_is_that_of_pairs(spark):
    """The sums over all pairs, without a row for each."""
    by = ["symbol", "stmt"]
    turned, facts = (crossdoc.dated_facts(cells(spark, t), by, "file") for t in (True, False))
    want = crossdoc.pairs(turned, by, facts).where("doc_a <> doc_b").agg(F.sum("compared").alias("compared"), F.sum("same").alias("same")).first()
    got = crossdoc.total(turned, by, facts)
    assert got.first() == want and want.compared > 5
    assert "doc_a" not in got._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


def test_copies_side_by_side(spark):
    """Copies as columns say what copies as rows say: labels twice, rows that lie outside or are missing, NULLs."""
    rng, names = random.Random(3), ["items", "a", "b", "其中：c", "sum", "tax", "whole", "whole of all", ""]
    rows = []
    for t in range(120):
        order = [n for n in names if rng.random() < 0.85] + rng.choices(names, k=rng.randrange(3))
        if rng.random() < 0.3:
            rng.shuffle(order)
        for i, n in enumerate(order):
            rows.append((t, i, n if n or rng.random() < 0.8 else None, rng.choice([n, None]) if n in ("sum", "tax", "whole") else None, [None if n == "items" or rng.random() < 0.1 else float(rng.choice([1, 2, 3])) for _ in range(2)]))
    df = spark.createDataFrame(rows, "t int, row_idx int, label_norm string, concept string, vals array<double>").withColumn("label_raw", F.col("label_norm"))
    cases = {"drop": mutations.drop_row("whole"), "items out": mutations.drop_row("items"), "bump": mutations.bump("sum", 1), "shift": mutations.shift("a", 1), "scale": mutations.scale(10, "tax"), "all": mutations.scale(10000), "turn": mutations.reverse(), "set": mutations.overwrite("whole", 1.0)}
    identities = {"i": [("whole", -1, False), ("sum", 1, False), ("tax", 1, True)], "j": [("whole", -1, False), ("sum", 1, False)]}
    terms = spark.createDataFrame([(i, *t) for i, own in identities.items() for t in own], "ident string, concept string, coef int, optional boolean")
    ranges = [("items", "sum"), ("a", "whole")]
    for headers in (["d 0", "d1"], ["d 0", "none"]):
        head = lambda d: d.withColumn("header_text", F.get(F.array(*map(F.lit, headers)), F.col("col_idx")))  # noqa: B023, E731
        other = head(df.select("*", F.posexplode("vals").alias("col_idx", "value")).drop("vals"))
        found = mutations.detected(head(mutations.copies(df, cases)), other, ["t"], terms, spark.createDataFrame([("whole",), ("sum",)], "name string"), ranges)
        want = sorted(map(tuple, mutations.grid(found, ["t"], list(cases)).collect()))
        got = sorted(map(tuple, mutations.side_by_side(df, cases, ["t"], headers, identities, ["whole", "sum"], ranges).collect()))
        assert got == want and len(want) == 8 * 6 and all(0 < sum(w[2] for w in want if w[0] == m) for m in cases)
    assert mutations.side_by_side(df.limit(0), cases, ["t"], ["d0", "d1"], identities, ["whole"], ranges).count() == 0


def test_mutations_have_no_rows(spark):
    """One scan, one shuffle of rows, and no join, union or row for each copy."""
    from plumbline.plans import pairs

    df = pairs.mutation_grid(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Union" not in plan
    assert plan.count("Generate ") == 2  # the rows of a statement, and the grid's own


def test_rows_of_one_place_are_one_fact(spark):
    """Two rows with one place and label, but other values, agree with the unharmed copy, which has both."""
    df = spark.createDataFrame([(1, 0, "a", [1.0, 2.0]), (1, 0, "a", [3.0, 4.0]), (1, 1, "b", [5.0, 6.0])], "t int, row_idx int, label_norm string, vals array<double>").withColumns({"label_raw": F.col("label_norm"), "concept": F.lit(None).cast("string")})
    cases = {"bump": mutations.bump("b", 1), "all": mutations.scale(10)}
    got = sorted(map(tuple, mutations.side_by_side(df, cases, ["t"], ["d0", "d1"], {}, [], []).collect()))
    assert got == [("all", "other document", 1, 1), ("bump", "other document", 1, 1)]
