"""Operators on small tables, where a query's table doesn't reach a case."""

from pyspark.sql import functions as F

from plumbline.operators import asof, diagnosis, joins, pit, retrieval, segmenting, trust
from plumbline.operators import statements as S
from plumbline.streaming import live


def test_candidates_and_scores(spark):
    words = {"BS": ["资产", "负债"], "IS": ["收入", "利润"]}
    rows = spark.createDataFrame([(1, 0, 5, "收入 利润 附注", True), (1, 1, 3, "资产 负债", True), (1, 2, 1, "资产", False), (2, 0, 9, "附注", False)], "page int, strategy int, top int, flat string, head boolean")
    scored = rows.withColumn("score", S.candidate_score(F.col("flat"), words, ["附注"], F.col("head")))
    assert {(r.page, r.strategy): r.score for r in scored.collect()} == {(1, 0): 2, (1, 1): 4, (1, 2): 1, (2, 0): -2}
    assert [(r.page, r.strategy) for r in S.short_circuit(scored, ["page"], "strategy", "score", least=S.MIN_SCORE).collect()] == [(1, 1)]


def test_runners_are_recognised(spark):
    from plumbline.functions import text as T

    rows = spark.createDataFrame([(1, 0, ["格力电器股份有限公司2023年年度报告"]), (1, 1, ["目录", ""]), (1, 2, ["货币资金", "1,234,567"]), (1, 3, ["目录"])], "t int, n int, cells array<string>")
    assert [r.n for r in S.without_runners(rows, ["t"], "n", T.is_runner(F.col("cells"))).orderBy("n").collect()] == [2, 3]


def test_pairs_and_smallest(spark):
    df = spark.createDataFrame([(1, True, 3), (1, False, 3), (2, True, 1), (2, False, 4)], "page int, crop boolean, score int")
    assert sorted((r.page, r.crop) for r in joins.pairwise(df, ["page"], F.col("crop"), F.col("score")).collect()) == [(1, True), (2, False)]
    assert joins.smallest(df.limit(0), "score", "page").count() == 0


def test_windows_and_union_of_days(spark):
    days = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in range(1, 20)], "d string").select(F.to_date("d").alias("day"))
    facts = spark.createDataFrame([("2024-01-01", "2024-01-05"), ("2024-01-01", "2024-01-03"), ("2024-01-04", "2024-01-08"), ("2024-01-15", "2024-01-12")], "p string, a string").select(F.to_date("p").alias("p"), F.to_date("a").alias("a"))
    assert sorted(r.trade_days for r in pit.windows(facts, days, "p", "a").collect()) == [0, 2, 4, 4]
    assert pit.covered_days(facts, days, "p", "a").count() == 7


def test_as_of_answers(spark):
    answers = spark.createDataFrame([(1, "NOT-YET", "2024-01-05", "2023年收入？", "尚未披露[片段1][片段2]", ["9"]), (2, "AVAILABLE", "2024-01-05", "问 77？", "收入 1207.76 亿元与 77，2023年", ["1207.76"]), (3, "TRAP", "2024-02-05", "?", "收入 1207.76", ["1,207.76"]), (4, "AVAILABLE", "2024-02-05", "?", "  ", ["1"])], "id int, kind string, d string, question string, answer string, expect array<string>").withColumn("as_of", F.to_date("d"))
    picked = spark.createDataFrame([(1, 1, "2024-01-01"), (1, 2, "2024-01-09")], "id int, rank int, d string").select("id", "rank", F.to_date("d").alias("announced"))
    documents = spark.createDataFrame([("x", "共 120,776,000,000.0 元", "2024-02-01"), ("y", "77", "2024-02-01")], "doc string, text string, d string").select("doc", "text", F.to_date("d").alias("announced"))
    got = {r.id: r for r in asof.judged(answers, picked, documents, ["id"]).collect()}
    assert [(got[i].bad_cites, got[i].leaks, got[i].abstained, got[i].hit, got[i].empty, got[i].ok) for i in (1, 2, 3, 4)] == [(1, 2, True, False, False, False), (0, 1, False, True, False, False), (0, 0, False, True, False, True), (0, 0, False, False, True, False)]


def test_traced_numbers_and_rates(spark):
    df = spark.createDataFrame([(1, "收入 88[片段1]。成本 99[片段1]。2023年 5。无数字。", ["有 88", "有 99 与 5"])], "id int, body string, fragments array<string>")
    got = {r.number: (r.in_corpus, r.traceable) for r in retrieval.traced_numbers(df, "body", "fragments").collect()}
    assert got == {"88": (True, True), "99": (True, False), "1": (False, False), "5": (True, False)} or got["88"] == (True, True) and got["99"] == (True, False) and got["5"] == (True, False)
    r = retrieval.report_rates(df, ["id"], "body", "fragments").first()
    assert (r.sentences, r.years, r.cited_sentences) == (4, 1, 2) and 0 < r.traced_rate < r.corpus_rate <= 1


def test_trust_of_tables(spark):
    lines = spark.createDataFrame([("t", "货币资金合计", "元"), ("t", "x", None), ("u", "x", None)], "id string, label_norm string, unit string")
    verdicts = spark.createDataFrame([("t", "i", "pass"), ("u", "i", "fail")], "id string, ident string, verdict string")
    strong = spark.createDataFrame([(s,) for s in trust.STRONG["BS"]], "label string")
    assert {r.id: (r.strong, r.unit_known, r.ident_fail) for r in trust.table_trust(lines, verdicts, strong, ["id"]).collect()} == {"t": (True, True, False), "u": (False, False, True)}
    assert trust.REVENUE[0] == "营业总收入"


def test_gate_and_band(spark):
    rows = F.array(F.array(F.lit("项目"), F.lit(None).cast("string")), F.array(F.lit("货币资金"), F.lit("1")))
    got = spark.range(1).select(segmenting.gate(rows, F.lit("BS")).alias("a"), segmenting.gate(rows, F.lit("IS")).alias("b"), segmenting.in_band(F.lit(115)).alias("c"), segmenting.in_band(F.lit(741)).alias("d"), segmenting.width(rows).alias("e"), segmenting.page_list(F.array(F.lit(3), F.lit(1), F.lit(3))).alias("f")).first()
    assert tuple(got) == (True, False, True, False, 2, [1, 3])


def test_ranks_are_whole_with_any_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    ranked = joins.ranked_globally(df, "k").collect()
    assert [r.k for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(r.k for r in ranked) and [r["rank"] for r in sorted(ranked, key=lambda r: r["rank"])] == list(range(5000))


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 5.0), (2, "2024-01-01 00:10:00", 7.0), (9, "2024-01-03 00:00:00", 0.0)]
    for name, own in (("a", rows), ("b", [(1, "2024-01-01 00:05:00", 5.5), (9, "2024-01-03 00:00:00", 0.0)])):
        spark.createDataFrame(own, "k int, t string, v double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.readStream.schema("k int, t timestamp, v double").parquet(f"{tmp_path}/{n}")
    for name, df, mode in (("joined", live.reconciled_stream(read("a"), read("b"), "k", "t", "v"), "append"), ("seen", live.visible_counts(read("a"), "t"), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {(r.key_a, r._merge, r.diff) for r in spark.table("joined").collect()} >= {(1, "both", 0.5)}
    assert sorted(r.n for r in spark.table("seen").collect()) == [1, 2]


def test_a_stream_reports_what_only_one_side_has(spark, tmp_path):
    for name, extra in (("a", 2), ("b", 3)):
        for n, own in enumerate(([(1, "2024-01-01 00:00:00", 5.0), (extra, "2024-01-01 00:10:00", 7.0)], [(9, "2024-01-05 00:00:00", 0.0)], [(10, "2024-01-06 00:00:00", 0.0)])):
            spark.createDataFrame(own, "k int, t string, v double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.readStream.schema("k int, t timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}")
    query = live.reconciled_stream(read("a"), read("b"), "k", "t", "v").writeStream.format("memory").queryName("sides").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.key_a, r.key_b, r._merge) for r in spark.table("sides").collect()}
    assert {(1, 1, "both"), (2, None, "left_only"), (None, 3, "right_only"), (9, 9, "both")} <= got
