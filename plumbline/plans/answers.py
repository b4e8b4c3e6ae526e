"""Queries on retrieval, citations and number tracing."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import asof, diagnosis, joins, pit, postings, retrieval
from plumbline.plans.market import table


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return retrieval.chunks(d, "doc_id", "text")


CHUNK = ["doc_id", "chunk_no"]
CHUNKS = """
docs AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''),
chunks AS (SELECT doc_id, i AS chunk_no, i * 580 AS start, substr(text, i * 580 + 1, 700) AS chunk
  FROM (SELECT *, unnest(range(ceil(greatest(n - 700, 0) / 580)::BIGINT + 1)) AS i FROM docs))"""
GRAMS = "list_distinct(list_transform(range(1, length({t})), lambda i: substr({t}, i, 2)))"
BARE = r"regexp_replace({t}, '\s', '', 'g')"
FORCED = "list_transform(regexp_extract_all({t}, '[0-9][0-9,.]{{2,}}'), lambda f: replace(f, ',', ''))"


def chunked(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", "start", F.md5("chunk").alias("digest"))


def corpus_stats(spark, sf_dir):
    return _chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.sum(F.char_length("chunk")).alias("chars"), F.count_distinct("doc_id").alias("docs"))


def gram_weights(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return retrieval.idf(retrieval.grams(c, CHUNK, "chunk"), c.agg(F.count("*").alias("n")))


def _questions(spark, sf_dir):
    """Benchmark items as questions, every other one with a number in it."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.concat("text", F.when(F.col("item_id") % 2 == 0, " 5,55").otherwise("")).alias("question"))


def retrieved(spark, sf_dir):
    """The six best chunks for each question, with the bonus for its numbers."""
    index = postings.built(_chunks(spark, sf_dir), CHUNK, "chunk")
    return postings.search(index, _questions(spark, sf_dir), ["item_id"], "question", 6).select("item_id", *CHUNK, "rank", F.round("score", 6).alias("score"))


def fact_ranks(spark, sf_dir):
    """Where the chunks that hold an item's last word rank for it, and who is to blame."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.element_at(F.split("text", r"\s+"), -1).alias("fact"))
    index = postings.built(_chunks(spark, sf_dir), CHUNK, "chunk")
    ranks = postings.fact_ranks(index, b, ["item_id"], "text", "fact", bonus=False)
    return diagnosis.fault(ranks.withColumn("hit", F.col("item_id") % 3 == 0), "hit")


SCORED = rf"""
g AS (SELECT doc_id, chunk_no, unnest({GRAMS.format(t="b")}) AS gram FROM (SELECT doc_id, chunk_no, {BARE.format(t="chunk")} AS b FROM chunks)),
w AS (SELECT gram, count(*) AS df, ln(1 + (SELECT count(*) FROM chunks) / (1 + count(*)))::DECIMAL(18, 6) AS idf FROM g GROUP BY gram)"""


def ranked_sql(questions: str, bonus: str) -> str:
    """Every chunk scored for every question (item_id, question)."""
    return rf"""q0 AS ({questions}),
q AS (SELECT item_id, question, {GRAMS.format(t="b")} AS gs FROM (SELECT *, {BARE.format(t="question")} AS b FROM q0)),
qg AS (SELECT item_id, unnest(gs) AS gram FROM q),
s AS (SELECT item_id, doc_id, chunk_no, sum(idf)::DOUBLE AS total FROM g JOIN w USING (gram) JOIN qg USING (gram) GROUP BY ALL),
r AS (SELECT item_id, doc_id, chunk_no, chunk, round(coalesce(total, 0) / greatest(sqrt(len(gs)), 1), 9) + {bonus} AS score FROM q CROSS JOIN chunks LEFT JOIN s USING (item_id, doc_id, chunk_no)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC, chunk_no DESC) AS rank FROM r)"""


BONUS = f"0.6 * coalesce(list_sum(list_transform({FORCED.format(t='question')}, lambda f: contains(replace(chunk, ',', ''), f)::INT)), 0)"


def as_of_weights(spark, sf_dir):
    """Bigram weights of items visible at each date: the filter comes before the counts."""
    seen = pit.visible(_dated(spark, sf_dir), _dates(spark), "announced")
    n = seen.groupBy("as_of").agg(F.count("*").alias("n"))
    return retrieval.idf(retrieval.grams(seen, ["as_of", "item_id"], "text"), n, ["as_of"])


def _cite(k):
    return F.concat(F.lit("[片段"), k.cast("string"), F.lit("]"))


def _answers(spark, sf_dir):
    """Answers about items: text with citations of fragments, some out of range."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split("text", r"\s+")
    return b.select("item_id", F.concat("text", _cite(F.col("item_id") % 4 + 1), F.when(F.col("item_id") % 3 == 0, _cite(F.col("item_id") % 5 + 3)).otherwise("")).alias("answer"), words.alias("accept"))


def _picked(spark, sf_dir):
    """Fragments shown with an item: its own text and its neighbour's, three times."""
    b = table(spark, sf_dir, "benchmark")
    near = b.select((F.col("item_id") - 1).alias("item_id"), F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("rank"), F.col("text").alias("chunk"))
    return near.unionByName(b.select("item_id", F.lit(1).alias("rank"), F.col("text").alias("chunk")))


ANSWERS = r"""
answers AS (SELECT item_id, text || '[片段' || (item_id % 4 + 1) || ']' || CASE WHEN item_id % 3 = 0 THEN '[片段' || (item_id % 5 + 3) || ']' ELSE '' END AS answer,
  regexp_split_to_array(text, '\s+') AS accept FROM benchmark),
picked AS (SELECT item_id - 1 AS item_id, unnest([2, 3, 4]) AS rank, text AS chunk FROM benchmark UNION ALL SELECT item_id, 1, text FROM benchmark),
cited AS (SELECT item_id, accept, unnest(regexp_extract_all(answer, '\[片段\s*([0-9]+)\]', 1))::INT AS rank FROM answers),
audit AS (SELECT item_id, c.rank AS citation, chunk IS NOT NULL AS in_range,
  coalesce(list_bool_or(list_transform(accept, lambda a: contains(regexp_replace(chunk, '[,\s，]', '', 'g'), regexp_replace(a, '[,\s，]', '', 'g')))), false) AS supported
  FROM cited c LEFT JOIN picked p USING (item_id, rank))"""


def citation_audit(spark, sf_dir):
    return retrieval.audited(_answers(spark, sf_dir), _picked(spark, sf_dir), "item_id", "answer", "accept")


def citation_rates(spark, sf_dir):
    return retrieval.citation_rates(citation_audit(spark, sf_dir), "item_id")


def citation_probe(spark, sf_dir):
    """Which of two facts each fragment of an item holds: its own first word, its neighbour's last."""
    w = F.split("text", r"\s+")
    b = table(spark, sf_dir, "benchmark")
    facts = b.select("item_id", F.lit("own").alias("name"), F.get(w, F.lit(0)).alias("fact")).unionByName(b.select(F.col("item_id") - 1, F.lit("other"), F.get(w, F.size(w) - 1)).toDF("item_id", "name", "fact"))
    return diagnosis.probe(_picked(spark, sf_dir), facts, ["item_id"])


PHRASES = (("资料中未包含该信息。", 5), ("[片段2]", 2), ("收入为 1,234.5 元。", 3))


def _replies(spark, sf_dir):
    """Assistant turns as answers: their text with an abstention, a citation or a number behind it."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    key = F.col("conv_id") * 7 + F.col("turn")
    return c.select("conv_id", "turn", key.alias("key"), F.concat("text", *[F.when(key % k == 0, phrase).otherwise("") for phrase, k in PHRASES]).alias("answer"))


REPLIES = "replies AS (SELECT conv_id, turn, conv_id * 7 + turn AS key, text || " + " || ".join(f"CASE WHEN (conv_id * 7 + turn) % {k} = 0 THEN '{p}' ELSE '' END" for p, k in PHRASES) + " AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)"


def answer_rates(spark, sf_dir):
    """Rates over replies; what they cite, say and leave open is read from their texts."""
    a = F.col("answer")
    # the cited fragment is the conversation's own turn, without what was added to it
    rows = _replies(spark, sf_dir).select((F.col("key") % 4 != 0).alias("in_corpus"), (F.size(T.citations(a)) > 0).alias("cited"), a.rlike("^[A-M]").alias("has_fact"), T.abstains(a).alias("abstained"), a.contains("1,234.5").alias("hit"))
    return retrieval.answer_rates(rows)


def _runs(spark, sf_dir):
    """Replies as runs of four arms at dates, judged by what they cite and state."""
    kind = F.when(F.col("key") % 4 == 0, "NOT-YET").when(F.col("key") % 7 == 0, "TRAP").otherwise("AVAILABLE")
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int"))
    runs = _replies(spark, sf_dir).select(
        "conv_id", "turn", F.element_at(F.array(*map(F.lit, asof.ARMS)), (F.col("conv_id") % 4 + 1).cast("int")).alias("arm"), (F.col("turn") % 3).alias("rep"), kind.alias("kind"), day(F.col("key") % 50).alias("as_of"),
        F.lit("多少？").alias("question"), F.when(F.col("key") % 17 == 0, " ").otherwise(F.col("answer")).alias("answer"), F.array(F.lit("1234.5")).alias("expect"),
    )
    picked = runs.select("conv_id", "turn", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"), F.date_add("as_of", (F.col("turn") % 5 - 2).cast("int")).alias("announced"))
    documents = spark.createDataFrame([(1, "收入 1,234.50 与 12345000", "2024-01-20")], "doc long, text string, day string").select("doc", "text", F.to_date("day").alias("announced"))
    return asof.judged(runs, picked, documents, ["conv_id", "turn"])


def answer_verdicts(spark, sf_dir):
    return _runs(spark, sf_dir).select("conv_id", "turn", "bad_cites", "leaks", "abstained", "hit", "empty", "ok")


# whether a number is written in any of its ways in the only document of ``_runs``
PLAIN = "replace(n, ',', '')::DOUBLE"
WRITTEN = "list_bool_or(list_transform([replace(n, ',', '')] || CASE WHEN " + PLAIN + " < 1e7 THEN [" + ", ".join(f"format('{{:.2f}}', {PLAIN} * {k}), floor({PLAIN} * {k})::BIGINT::VARCHAR" for k in (10000, 100000000)) + "] ELSE [] END || CASE WHEN " + PLAIN + " >= 1e8 THEN [" + ", ".join(f"format('{{:.2f}}', {PLAIN} / {k})" for k in (10000, 100000000)) + "] ELSE [] END, lambda v: contains('收入1234.50与12345000', v)))"
RUNS = rf"""{REPLIES},
base AS (SELECT conv_id, turn, ['A', 'B', 'C', 'D'][conv_id % 4 + 1] AS arm, turn % 3 AS rep, CASE WHEN key % 4 = 0 THEN 'NOT-YET' WHEN key % 7 = 0 THEN 'TRAP' ELSE 'AVAILABLE' END AS kind,
  DATE '2024-01-01' + (key % 50)::INT AS as_of, CASE WHEN key % 17 = 0 THEN ' ' ELSE answer END AS answer, key % 17 = 0 AS empty FROM replies),
facts AS (SELECT *, len(regexp_extract_all(answer, '\[片段2\]')) * (turn % 5 > 2)::INT AS bad_cites, CASE WHEN as_of < DATE '2024-01-20' THEN len(list_filter(list_distinct(regexp_extract_all(answer, '[0-9][0-9,]*(?:\.[0-9]+)?')), lambda n: NOT regexp_full_match(replace(n, ',', ''), '(19|20)[0-9]{{2}}') AND {WRITTEN})) ELSE 0 END AS leaks,
  contains(answer, '未包含') AS abstained, contains(answer, '1,234.5') AS hit FROM base),
judged AS (SELECT *, CASE WHEN empty THEN false WHEN kind = 'NOT-YET' THEN abstained AND bad_cites = 0 AND leaks = 0 ELSE hit AND bad_cites = 0 AND leaks = 0 END AS ok FROM facts),
s AS (SELECT arm, rep, avg((bad_cites > 0 AND NOT empty)::INT) AS cite_violation, avg((leaks > 0 AND NOT empty)::INT) AS num_violation, avg(ok::INT) AS correct,
  coalesce(count(*) FILTER (kind = 'AVAILABLE' AND ok) / nullif(count(*) FILTER (kind = 'AVAILABLE'), 0), 0) AS available, coalesce(count(*) FILTER (kind = 'NOT-YET' AND ok) / nullif(count(*) FILTER (kind = 'NOT-YET'), 0), 0) AS not_yet,
  coalesce(count(*) FILTER (kind = 'TRAP' AND ok) / nullif(count(*) FILTER (kind = 'TRAP'), 0), 0) AS trap, avg(abstained::INT) AS abstain_rate, count(*) FILTER (empty) AS engine_fail FROM judged GROUP BY 1, 2)"""


def arm_summaries(spark, sf_dir):
    return retrieval.arm_summary(_runs(spark, sf_dir))


def arm_ranges(spark, sf_dir):
    out = retrieval.over_repetitions(arm_summaries(spark, sf_dir), ["correct", "available"])
    return out.select("arm", *[F.round(c, 9).alias(c) for c in out.columns if c != "arm"])


def _dated(spark, sf_dir):
    """Benchmark items with the day on which each was announced."""
    return table(spark, sf_dir, "benchmark").withColumn("announced", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 40).cast("int")))


def _dates(spark):
    return spark.createDataFrame([("2024-01-10",), ("2024-01-25",)], "d string").select(F.to_date("d").alias("as_of"))


def arm_pools(spark, sf_dir):
    """How many items each arm of an evaluation may retrieve at each date."""
    return asof.arms(_dates(spark), _dated(spark, sf_dir)).groupBy("arm", "as_of").agg(F.count("*").alias("items"), F.max("announced").alias("latest"))


def inventories(spark, sf_dir):
    """What is disclosed by each date, as the list that is shown."""
    m = _dated(spark, sf_dir).select("announced", F.lpad(F.col("item_id").cast("string"), 6, "0").alias("title"))
    return asof.inventory(m, _dates(spark)).select("as_of", F.md5("inventory").alias("digest"))


def _reports(spark, sf_dir):
    """Documents with numbers as report sections: their lines as sentences, every third one citing."""
    d = table(spark, sf_dir, "documents").where("text rlike '[0-9]'")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.regexp_replace(x, "[。；]", ""), F.when(i % 3 == 0, "[片段1]").otherwise(""), F.lit("。")))
    fragments = F.array(F.get(F.split("text", "\n"), F.lit(0)), F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("")))
    return d.select("doc_id", F.array_join(lines, "").alias("body"), fragments.alias("fragments"))


def report_rates(spark, sf_dir):
    """Numbers of each document, how many are traced to what their sentence
    cites (T1) or found in the first two lines at all (T3), and how many
    sentences with numbers cite (T2)."""
    out = retrieval.report_rates(_reports(spark, sf_dir), ["doc_id"], "body", "fragments")
    return out.select("doc_id", "sentences", "cited_sentences", "years", "numbers", "traced", "in_corpus", F.round("traced_rate", 9).alias("traced_rate"), F.round("corpus_rate", 9).alias("corpus_rate"))


def page_names(spark, sf_dir):
    """The most specific heading on each page of a made-up report, by order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    text = F.concat(F.when(k == 0, "合并资产负债表 主要会计数据").when(k == 1, "利润表").when(k == 2, "母公司现金流量表").when(k == 3, "目录").otherwise("合并现金流量表"), F.col("o_orderstatus"))
    return diagnosis.page_names(o.select("o_orderkey", text.alias("text"))).groupBy("name").agg(F.count("*").alias("pages"))


def usage_tokens(spark, sf_dir):
    """Numbers out of nested JSON, with defaults where a level is missing or nothing is JSON."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    doc = F.when(k % 4 == 0, F.concat(F.lit('{"usage": {"details": {"reasoning": '), k.cast("string"), F.lit("}}}"))).when(k % 4 == 1, '{"usage": {}}').when(k % 4 == 2, "no JSON")
    return o.select("o_orderkey", T.nested(doc, "usage.details.reasoning", F.lit("0")).cast("long").alias("tokens"))


def enriched_chunks(spark, sf_dir):
    """Chunks with what the manifest says of their document."""
    manifest = table(spark, sf_dir, "documents").where("source is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    c = joins.enriched(_chunks(spark, sf_dir).select("doc_id", "chunk_no"), manifest, ["doc_id"])
    return c.groupBy("source").agg(F.count("*").alias("chunks"))


def number_tokens(spark, sf_dir):
    """Numbers in documents, without years, and how many of four digits or more."""
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.numbers(F.col("text"), without_years=True)).alias("number"))
    return n.groupBy("doc_id").agg(F.count("*").alias("numbers"), F.count_if(F.char_length(F.replace("number", F.lit(","), F.lit(""))) >= 4).alias("long_numbers"))


def traced_numbers(spark, sf_dir):
    """Each number of each document: how often it is stated, how often in a
    sentence that cites a fragment which holds it, and whether any fragment does."""
    n = retrieval.traced_numbers(_reports(spark, sf_dir), "body", "fragments")
    return n.groupBy("doc_id", "number").agg(F.count("*").alias("stated"), F.count_if("traceable").alias("traced"), F.bool_or("in_corpus").alias("in_corpus"))


def compacted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.compact(F.col("text"))).alias("digest"), F.md5(T.squeezed(F.col("text"))).alias("squeezed"))


def title_periods(spark, sf_dir):
    """Periods, units and symbols of titles built from orders."""
    o = table(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, ("年度报告", "半年度报告", "第一季度报告", "第三季度报告", "公告")))
    title = F.concat(F.lit("甲公司"), F.year("o_orderdate").cast("string"), F.lit("年"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")))
    t = o.select("o_orderkey", title.alias("title"), F.lpad((F.col("o_custkey") * 37 % 1000000).cast("string"), 6, "0").alias("code"))
    return t.select("o_orderkey", T.period_of(F.col("title")).alias("period"), T.company_period(F.col("title")).alias("annual"), T.is_report(F.col("title")).alias("is_report"), T.exchange_symbol(F.col("code")).alias("symbol"))


# of all ways in which a number is written, the whole ones are the shortest: any other has one of them in it
HELD = r"list_bool_or(list_transform([replace(number, ',', '')] || CASE WHEN x < 1e6 THEN [floor(x * 10000)::BIGINT::VARCHAR, floor(x * 100000000)::BIGINT::VARCHAR] ELSE [] END, lambda v: contains({f}, v)))"
TRACED = rf"""
d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE regexp_matches(text, '[0-9]')),
l AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i, regexp_replace(lines[1], '[,\s，]', '', 'g') AS f1, regexp_replace(coalesce(lines[2], ''), '[,\s，]', '', 'g') AS f2 FROM d),
r AS (SELECT *, regexp_extract_all(x || CASE WHEN i % 3 = 0 THEN '[片段1]' ELSE '' END, '[0-9][0-9,]*(?:\.[0-9]+)?') AS all_n FROM l),
s AS (SELECT *, list_filter(all_n, lambda v: NOT regexp_full_match(replace(v, ',', ''), '(19|20)[0-9]{{2}}')) AS own_n FROM r),
m AS (SELECT doc_id, i, f1, f2, unnest(own_n) AS number FROM s),
n AS (SELECT doc_id, number, i % 3 = 0 AND {HELD.format(f="f1")} AS traceable, {HELD.format(f="f1")} OR {HELD.format(f="f2")} AS in_corpus FROM (SELECT *, replace(number, ',', '')::DOUBLE AS x FROM m))"""


QUERIES = {f.__name__: f for f in (
    chunked, corpus_stats, gram_weights, retrieved, fact_ranks, as_of_weights, citation_audit, citation_rates, citation_probe, answer_rates, answer_verdicts, arm_summaries, arm_ranges, arm_pools, inventories,
    report_rates, page_names, usage_tokens, enriched_chunks, number_tokens, traced_numbers, compacted, title_periods,
)}

ORACLES = {
    "chunked": f"WITH {CHUNKS} SELECT doc_id, chunk_no, start, md5(chunk) AS digest FROM chunks",
    "corpus_stats": f"WITH {CHUNKS} SELECT count(*) AS chunks, sum(length(chunk))::BIGINT AS chars, count(DISTINCT doc_id) AS docs FROM chunks",
    "gram_weights": f"WITH {CHUNKS}, {SCORED} SELECT * FROM w",
    "retrieved": f"WITH {CHUNKS}, {SCORED}, " + ranked_sql("SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ' 5,55' ELSE '' END AS question FROM benchmark", BONUS) + " SELECT item_id, doc_id, chunk_no, rank, round(score, 6) AS score FROM ranked WHERE rank <= 6",
    "fact_ranks": f"WITH {CHUNKS}, {SCORED}, " + ranked_sql("SELECT item_id, text AS question FROM benchmark", "0") + """,
p AS (SELECT item_id, count(*) FILTER (h) AS owners, min(rank) FILTER (h) AS best_rank, count(*) FILTER (h AND rank <= 6) AS in_top FROM (SELECT r.*, contains(regexp_replace(chunk, '[,\\s，]', '', 'g'), regexp_replace(regexp_split_to_array(text, '\\s+')[-1], '[,，]', '', 'g')) AS h FROM ranked r JOIN benchmark USING (item_id)) GROUP BY 1)
SELECT *, item_id % 3 = 0 AS hit, CASE WHEN item_id % 3 = 0 THEN 'none' WHEN best_rank IS NULL THEN 'corpus' WHEN best_rank > 6 THEN 'retrieval' ELSE 'generation' END AS fault FROM p""",
    "as_of_weights": rf"""WITH seen AS (SELECT as_of, item_id, {BARE.format(t="text")} AS b FROM benchmark, (SELECT unnest([DATE '2024-01-10', DATE '2024-01-25']) AS as_of) WHERE DATE '2024-01-01' + (item_id % 40)::INT <= as_of),
g AS (SELECT as_of, item_id, unnest({GRAMS.format(t="b")}) AS gram FROM seen), n AS (SELECT as_of, count(*) AS n FROM seen GROUP BY 1)
SELECT as_of, gram, count(*) AS df, ln(1 + any_value(n) / (1 + count(*)))::DECIMAL(18, 6) AS idf FROM g JOIN n USING (as_of) GROUP BY 1, 2""",
    "citation_audit": f"WITH {ANSWERS} SELECT * FROM audit",
    "citation_rates": f"WITH {ANSWERS}, p AS (SELECT item_id, bool_and(in_range AND supported) AS a, count(*) FILTER (in_range) AS n, count(*) FILTER (in_range AND supported) AS ok FROM audit GROUP BY 1) SELECT sum(ok) / sum(n) AS precision, avg(a::INT) AS all_right_share FROM p",
    "citation_probe": rf"""WITH {ANSWERS}, f AS (SELECT item_id, 'own' AS name, regexp_split_to_array(text, '\s+')[1] AS fact FROM benchmark UNION ALL SELECT item_id - 1, 'other', regexp_split_to_array(text, '\s+')[-1] FROM benchmark)
SELECT item_id, rank, name, contains(regexp_replace(chunk, '[,\s，]', '', 'g'), regexp_replace(fact, '[,\s，]', '', 'g')) AS holds FROM picked JOIN f USING (item_id)""",
    "answer_rates": f"""WITH {REPLIES}, r AS (SELECT key % 4 <> 0 AS i, contains(answer, '[片段2]') AS c, regexp_matches(answer, '^[A-M]') AS f, contains(answer, '1,234.5') AS h, contains(answer, '未包含') AS a FROM replies)
SELECT count(*) FILTER (i AND c) / count(*) FILTER (i) AS cited_rate, coalesce(count(*) FILTER (f AND i AND c) / nullif(count(*) FILTER (i AND c), 0), 0) AS fact_rate, coalesce(count(*) FILTER (a AND NOT i) / nullif(count(*) FILTER (NOT i), 0), 0) AS abstain_rate, count(*) FILTER (CASE WHEN i THEN h ELSE a END) AS passed, count(*) AS questions FROM r""",
    "answer_verdicts": f"WITH {RUNS} SELECT conv_id, turn, bad_cites, leaks, abstained, hit, empty, ok FROM judged",
    "arm_pools": "WITH i AS (SELECT DATE '2024-01-01' + (item_id % 40)::INT AS announced FROM benchmark), d AS (SELECT unnest([DATE '2024-01-10', DATE '2024-01-25']) AS as_of), a AS (SELECT unnest(['A', 'B', 'C', 'D']) AS arm) SELECT arm, as_of, count(*) AS items, max(announced) AS latest FROM a CROSS JOIN d JOIN i ON arm IN ('A', 'B') OR announced <= as_of GROUP BY 1, 2",
    "inventories": "WITH i AS (SELECT DATE '2024-01-01' + (item_id % 40)::INT AS announced, lpad(item_id::VARCHAR, 6, '0') AS title FROM benchmark), d AS (SELECT unnest([DATE '2024-01-10', DATE '2024-01-25']) AS as_of) SELECT as_of, md5(string_agg('- ' || title || '（公告日 ' || announced || '）', chr(10) ORDER BY announced, title)) AS digest FROM d JOIN i ON announced <= as_of GROUP BY 1",
    "report_rates": f"""WITH {TRACED}, t AS (SELECT doc_id, count(*) AS numbers, count(*) FILTER (traceable) AS traced, count(*) FILTER (in_corpus) AS in_corpus FROM n GROUP BY 1),
u AS (SELECT doc_id, count(*) AS sentences, count(*) FILTER (i % 3 = 0) AS cited_sentences, sum(len(all_n) - len(own_n))::BIGINT AS years FROM s GROUP BY 1)
SELECT doc_id, sentences, cited_sentences, years, coalesce(numbers, 0) AS numbers, coalesce(traced, 0) AS traced, coalesce(in_corpus, 0) AS in_corpus, round(traced / numbers, 9) AS traced_rate, round(in_corpus / numbers, 9) AS corpus_rate FROM u LEFT JOIN t USING (doc_id)""",
    "page_names": "SELECT CASE o_orderkey % 5 WHEN 0 THEN '合并资产负债表' WHEN 1 THEN '利润表' WHEN 2 THEN '现金流量表' ELSE '合并现金流量表' END AS name, count(*) AS pages FROM orders WHERE o_orderkey % 5 <> 3 GROUP BY 1",
    "usage_tokens": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE 0 END AS tokens FROM orders",
    "enriched_chunks": f"WITH {CHUNKS}, m AS (SELECT doc_id, min(source) AS source FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT source, count(*) AS chunks FROM chunks LEFT JOIN m USING (doc_id) GROUP BY 1",
    "arm_summaries": f"WITH {RUNS} SELECT * FROM s",
    "arm_ranges": f"WITH {RUNS} SELECT arm, " + ", ".join(f"round({f}({c}), 9) AS {c}_{n}" for c in ("correct", "available") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM s GROUP BY arm",
    "number_tokens": r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?')) AS x FROM documents) SELECT doc_id, count(*) AS numbers, count(*) FILTER (length(replace(x, ',', '')) >= 4) AS long_numbers FROM n WHERE NOT regexp_full_match(replace(x, ',', ''), '(19|20)[0-9]{2}') GROUP BY 1""",
    "traced_numbers": f"WITH {TRACED} SELECT doc_id, number, count(*) AS stated, count(*) FILTER (traceable) AS traced, bool_or(in_corpus) AS in_corpus FROM n GROUP BY 1, 2",
    "compacted": r"SELECT doc_id, md5(regexp_replace(text, '[,\s，]', '', 'g')) AS digest, md5(regexp_replace(text, '[ \t]+', ' ', 'g')) AS squeezed FROM documents",
    "title_periods": """WITH t AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, ['年度报告', '半年度报告', '第一季度报告', '第三季度报告', '公告'][o_orderkey % 5 + 1] AS k, lpad((o_custkey * 37 % 1000000)::VARCHAR, 6, '0') AS code FROM orders)
SELECT o_orderkey, CASE WHEN k = '公告' THEN '' ELSE y || CASE o_orderkey % 5 WHEN 0 THEN 'FY' WHEN 1 THEN 'H1' WHEN 2 THEN 'Q1' ELSE 'Q3' END END AS period, y || 'FY' AS annual, k <> '公告' AS is_report, CASE WHEN code[1] IN ('6', '9') THEN 'sh' ELSE 'sz' END || code AS symbol FROM t""",
}
