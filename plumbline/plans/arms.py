"""Evaluation of the four arms as a whole: questions at dates, retrieval from one
index of all dates, answers by rule, verdicts from the answers' texts.

Documents are announced on a day of 2024 by their number, and each ends with its
code, a number that no other document has. A question is a benchmark item asked
on some day; what it expects is the code of the document that a search without
dates finds first. Its kind follows: available if that document is announced by
then, not yet if not, and a trap where the best document of that day is expected.
The answers, which in life come from a language model, follow each arm's rule: A
takes its first fragment, B the first that isn't of the future or abstains, C the
first of its pool, and D abstains unless its inventory lists the document."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import asof, postings, retrieval
from plumbline.plans.answers import BARE, CHUNK, GRAMS
from plumbline.plans.market import table

DAYS = 365


def _documents(spark, sf_dir):
    start = F.lit("2024-01-01").cast("date")
    d = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null")
    code = (F.col("doc_id") + 100000).cast("string")
    return d.select("doc_id", F.concat("text", F.lit(" 第 "), code, F.lit(" 号")).alias("text"), F.date_add(start, (F.col("doc_id") % DAYS).cast("int")).alias("announced"))


def _index(spark, sf_dir):
    return postings.built(retrieval.chunks(_documents(spark, sf_dir), "doc_id", "text"), CHUNK, "chunk", "announced")


def _questions(spark, sf_dir):
    start = F.lit("2024-01-01").cast("date")
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("text").alias("question"), F.date_add(start, (F.col("item_id") * 37 % DAYS).cast("int")).alias("as_of"))


def arm_retrieved(spark, sf_dir):
    """The six fragments that each arm shows; C and D never show a later one."""
    picks = asof.arm_picks(_index(spark, sf_dir), _questions(spark, sf_dir), ["item_id"])
    return picks.select("arm", "item_id", "as_of", "rank", *CHUNK, "announced", F.round("score", 6).alias("score"))


def _answers(picks, questions):
    """Answers of the four arms by their rules."""
    code = lambda d: (d + 100000).cast("string")
    first = lambda arm, c: F.max(F.when((F.col("arm") == arm) & (F.col("rank") == 1), F.col(c)))
    seen = F.min(F.when((F.col("arm") == "B") & (F.col("announced") <= F.col("as_of")), F.struct("rank", "doc_id")))
    per = picks.groupBy("item_id").agg(first("A", "doc_id").alias("a"), first("A", "announced").alias("day"), seen.alias("b"), first("C", "doc_id").alias("c"))
    rows = questions.join(per, "item_id", "left")
    listed = F.col("day") <= F.col("as_of")
    kind = F.when(F.col("item_id") % 6 == 5, "TRAP").when(listed, "AVAILABLE").otherwise("NOT-YET")
    expect = F.array(code(F.when(F.col("item_id") % 6 == 5, F.col("c")).otherwise(F.col("a"))))
    abstain = F.lit("该日尚未披露。")
    said = {
        "A": F.when(F.col("item_id") % 13 == 0, " ").otherwise(F.concat(F.lit("第"), code(F.col("a")), F.lit("号[片段1][片段2]。"))),
        "B": F.coalesce(F.concat(F.lit("第"), code(F.col("b.doc_id")), F.lit("号[片段"), F.col("b.rank").cast("string"), F.lit("]。")), abstain),
        "C": F.coalesce(F.concat(F.lit("第"), code(F.col("c")), F.lit("号[片段1][片段2]。")), abstain),
        "D": F.coalesce(F.when(listed, F.concat(F.lit("第"), code(F.col("c")), F.lit("号[片段1]。"))), abstain),
    }
    each = F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), text.alias("answer")) for arm, text in said.items()]))
    return rows.select("item_id", "as_of", "question", kind.alias("kind"), expect.alias("expect"), F.lit(1).alias("rep"), each.alias("_a")).select("*", "_a.*").drop("_a")


def _judged(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    picks = asof.arm_picks(_index(spark, sf_dir), questions, ["item_id"])
    documents = _documents(spark, sf_dir).withColumnRenamed("doc_id", "doc")
    return asof.judged(_answers(picks, questions), picks.select("item_id", "arm", "rank", "announced"), documents, ["item_id", "arm"])


def arm_verdicts(spark, sf_dir):
    """Every answer of every arm with its violations and verdict."""
    return _judged(spark, sf_dir).select("arm", "item_id", "kind", "bad_cites", "leaks", "abstained", "hit", "empty", "ok")


def arm_outcomes(spark, sf_dir):
    """Violation rates and correctness of the four arms."""
    return retrieval.arm_summary(_judged(spark, sf_dir))


QUERIES = {f.__name__: f for f in (arm_retrieved, arm_verdicts, arm_outcomes)}

PICKS = rf"""
docs AS (SELECT doc_id, text || ' 第 ' || (doc_id + 100000) || ' 号' AS text, DATE '2024-01-01' + (doc_id % {DAYS})::INT AS announced FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
chunks AS (SELECT doc_id, announced, i AS chunk_no, substr(text, i * 580 + 1, 700) AS chunk
  FROM (SELECT *, unnest(range(ceil(greatest(length(text) - 700, 0) / 580)::BIGINT + 1)) AS i FROM docs)),
g AS (SELECT doc_id, chunk_no, announced, unnest({GRAMS.format(t="b")}) AS gram FROM (SELECT *, {BARE.format(t="chunk")} AS b FROM chunks)),
questions AS (SELECT item_id, text AS question, DATE '2024-01-01' + (item_id * 37 % {DAYS})::INT AS as_of FROM benchmark),
q AS (SELECT *, {GRAMS.format(t="b")} AS gs FROM (SELECT *, unnest(['AB', 'CD']) AS pool, {BARE.format(t="question")} AS b FROM questions)),
u AS (SELECT item_id, pool, gs, question, CASE WHEN pool = 'CD' THEN as_of ELSE DATE '9999-12-31' END AS until FROM q),
qg AS (SELECT item_id, pool, until, unnest(gs) AS gram FROM u),
held AS (SELECT item_id, pool, gram, doc_id, chunk_no FROM qg JOIN g USING (gram) WHERE announced <= until),
pool_size AS (SELECT item_id, pool, count(*) AS n FROM u JOIN chunks ON announced <= until GROUP BY ALL),
w AS (SELECT item_id, pool, gram, ln(1 + any_value(n) / (1 + count(*)))::DECIMAL(18, 6) AS idf FROM held JOIN pool_size USING (item_id, pool) GROUP BY ALL),
s AS (SELECT item_id, pool, doc_id, chunk_no, sum(idf)::DOUBLE AS total FROM held JOIN w USING (item_id, pool, gram) GROUP BY ALL),
r AS (SELECT item_id, pool, doc_id, chunk_no, announced, round(coalesce(total, 0) / greatest(sqrt(len(gs)), 1), 9)
    + 0.6 * coalesce(list_sum(list_transform(list_transform(regexp_extract_all(question, '[0-9][0-9,.]{{2,}}'), lambda f: replace(f, ',', '')), lambda f: contains(replace(chunk, ',', ''), f)::INT)), 0) AS score
  FROM u JOIN chunks ON announced <= until LEFT JOIN s USING (item_id, pool, doc_id, chunk_no)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, pool ORDER BY score DESC, doc_id DESC, chunk_no DESC) AS rank FROM r),
picks AS (SELECT unnest(string_split(pool, '')) AS arm, item_id, as_of, rank, doc_id, chunk_no, announced, round(score, 6) AS score FROM ranked JOIN questions USING (item_id) WHERE rank <= 6)"""

JUDGED = PICKS + r""",
per AS (SELECT item_id, max(doc_id) FILTER (arm = 'A' AND rank = 1) AS a, max(announced) FILTER (arm = 'A' AND rank = 1) AS day, min(rank) FILTER (arm = 'B' AND announced <= as_of) AS b_rank,
  arg_min(doc_id, rank) FILTER (arm = 'B' AND announced <= as_of) AS b, max(doc_id) FILTER (arm = 'C' AND rank = 1) AS c FROM picks GROUP BY 1),
facts AS (SELECT item_id, as_of, CASE WHEN item_id % 6 = 5 THEN 'TRAP' WHEN day <= as_of THEN 'AVAILABLE' ELSE 'NOT-YET' END AS kind, (CASE WHEN item_id % 6 = 5 THEN c ELSE a END + 100000)::VARCHAR AS expect,
  unnest([{'arm': 'A', 'said': CASE WHEN item_id % 13 = 0 THEN [] ELSE [(a + 100000)::VARCHAR] END, 'cites': CASE WHEN item_id % 13 = 0 THEN [] ELSE [1, 2] END, 'empty': item_id % 13 = 0},
    {'arm': 'B', 'said': CASE WHEN b IS NULL THEN [] ELSE [(b + 100000)::VARCHAR] END, 'cites': CASE WHEN b IS NULL THEN [] ELSE [b_rank] END, 'empty': false},
    {'arm': 'C', 'said': CASE WHEN c IS NULL THEN [] ELSE [(c + 100000)::VARCHAR] END, 'cites': CASE WHEN c IS NULL THEN [] ELSE [1, 2] END, 'empty': false},
    {'arm': 'D', 'said': CASE WHEN day <= as_of AND c IS NOT NULL THEN [(c + 100000)::VARCHAR] ELSE [] END, 'cites': CASE WHEN day <= as_of AND c IS NOT NULL THEN [1] ELSE [] END, 'empty': false}]) AS x
  FROM questions LEFT JOIN per USING (item_id)),
answers AS (SELECT item_id, as_of, kind, expect, x.arm AS arm, x.said AS said, x.cites AS cites, x.empty AS empty FROM facts),
late AS (SELECT a.item_id, a.arm, count(*) AS bad FROM (SELECT item_id, arm, as_of, unnest(cites) AS rank FROM answers) a JOIN picks p USING (item_id, arm, rank) WHERE p.announced > a.as_of GROUP BY ALL),
stated AS (SELECT item_id, arm, a.as_of, number FROM (SELECT item_id, arm, as_of, unnest(list_distinct(list_concat(said, list_transform(cites, lambda c: c::VARCHAR)))) AS number FROM answers) a JOIN questions USING (item_id)
  WHERE NOT list_contains(regexp_extract_all(question, '[0-9][0-9,]*(?:\.[0-9]+)?'), number)),
ways AS (SELECT number, unnest([number, format('{:.2f}', number::DOUBLE * 10000), (number::BIGINT * 10000)::VARCHAR, format('{:.2f}', number::DOUBLE * 100000000), (number::BIGINT * 100000000)::VARCHAR]) AS way FROM (SELECT DISTINCT number FROM stated)),
bare AS (SELECT announced, regexp_replace(text, '[ \t,]+', '', 'g') AS t FROM docs),
first AS (SELECT number, min(announced) AS day FROM ways JOIN bare ON contains(t, way) GROUP BY 1),
leaked AS (SELECT item_id, arm, count(*) AS leaks FROM stated JOIN first USING (number) WHERE day > as_of GROUP BY ALL),
flags AS (SELECT arm, item_id, kind, coalesce(bad, 0) AS bad_cites, coalesce(leaks, 0) AS leaks, len(said) = 0 AND NOT empty AS abstained,
  coalesce(list_contains(said, expect), false) AS hit, empty FROM answers LEFT JOIN late USING (item_id, arm) LEFT JOIN leaked USING (item_id, arm)),
judged AS (SELECT *, CASE WHEN empty THEN false WHEN kind = 'NOT-YET' THEN abstained AND bad_cites = 0 AND leaks = 0 ELSE hit AND bad_cites = 0 AND leaks = 0 END AS ok FROM flags)"""


def _share(kind: str) -> str:
    return f"coalesce(count(*) FILTER (kind = '{kind}' AND ok) / nullif(count(*) FILTER (kind = '{kind}'), 0), 0)"


ORACLES = {
    "arm_retrieved": f"WITH {PICKS} SELECT * FROM picks",
    "arm_verdicts": f"WITH {JUDGED} SELECT * FROM judged",
    "arm_outcomes": f"""WITH {JUDGED} SELECT arm, 1 AS rep, avg((bad_cites > 0 AND NOT empty)::INT) AS cite_violation, avg((leaks > 0 AND NOT empty)::INT) AS num_violation, avg(ok::INT) AS correct,
  {_share("AVAILABLE")} AS available, {_share("NOT-YET")} AS not_yet, {_share("TRAP")} AS trap, avg(abstained::INT) AS abstain_rate, count(*) FILTER (empty) AS engine_fail FROM judged GROUP BY 1""",
}
