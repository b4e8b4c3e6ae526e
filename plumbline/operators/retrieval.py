"""Retrieval with traceable answers: chunks, bigram weights, citation audits. The index is in ``postings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.joins import small

SIZE, OVERLAP = 700, 120
BONUS = 0.6  # for each forced number of the question that a chunk holds


def chunks(docs: DataFrame, doc: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs exploded to (chunk_no, start, chunk): windows of ``size`` characters;
    the last one ends at or beyond the text's end. Empty texts have none."""
    step = size - overlap
    n = F.char_length(text)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))
    out = docs.select("*", F.posexplode(starts).alias("chunk_no", "start"))
    return out.withColumn("chunk", F.substring(F.col(text), F.col("start") + 1, F.lit(size)))


def grams(pieces: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, gram): the set of bigrams of each piece."""
    return pieces.select(*ids, F.explode(T.bigrams(F.col(text))).alias("gram"))


def idf(postings: DataFrame, n: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, gram, df, idf), idf = ln(1 + n / (1 + df)) rounded to six decimals so
    that sums don't depend on their order; n: (by, n) pieces."""
    by = by or []
    df = postings.groupBy(*by, "gram").agg(F.count("*").alias("df"))
    joined = df.join(small(n), by) if by else df.crossJoin(F.broadcast(n))
    return joined.select(*by, "gram", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).cast("decimal(18,6)").alias("idf"))


def audited(answers: DataFrame, picked: DataFrame, qid: str, answer: str, accept: str) -> DataFrame:
    """One row a citation (qid, citation, in_range, supported): whether the cited
    fragment exists and holds an accepted fact (array of alternatives)."""
    cited = answers.select(qid, accept, F.explode(T.citations(F.col(answer))).alias("rank"))
    own = cited.join(picked.select(qid, "rank", "chunk"), [qid, "rank"], "left")
    return own.select(qid, F.col("rank").alias("citation"), F.col("chunk").isNotNull().alias("in_range"), F.coalesce(F.exists(accept, lambda a: F.contains(T.compact(F.col("chunk")), T.compact(a))), F.lit(False)).alias("supported"))


def citation_rates(audit: DataFrame, qid: str) -> DataFrame:
    """Precision over citations in range, and the share of questions all of whose citations are right."""
    per = audit.groupBy(qid).agg(F.bool_and(F.col("in_range") & F.col("supported")).alias("all_right"), F.count_if("in_range").alias("n"), F.count_if(F.col("in_range") & F.col("supported")).alias("ok"))
    return per.agg(F.try_divide(F.sum("ok"), F.sum("n")).alias("precision"), F.avg(F.col("all_right").cast("int")).alias("all_right_share"))


def answer_rates(rows: DataFrame) -> DataFrame:
    """Cited, citation has fact (over cited only, 0 if none), abstained on
    controls, and pass marks; rows: in_corpus, cited, has_fact, abstained, hit."""
    ok = F.when(F.col("in_corpus"), F.col("hit")).otherwise(F.col("abstained"))
    share = lambda good, of: F.coalesce(F.try_divide(F.count_if(good & of), F.count_if(of)), F.lit(0.0))
    inside, outside = F.col("in_corpus"), ~F.col("in_corpus")
    return rows.agg(share(F.col("cited"), inside).alias("cited_rate"), share(F.col("has_fact"), inside & F.col("cited")).alias("fact_rate"), share(F.col("abstained"), outside).alias("abstain_rate"), F.count_if(ok).alias("passed"), F.count("*").alias("questions"))


def judged(rows: DataFrame) -> DataFrame:
    """As-of verdicts: bad_cites, leaks (counts), abstained, hit, kind, empty →
    ok. An empty answer fails without being a violation."""
    clean = (F.col("bad_cites") == 0) & (F.col("leaks") == 0)
    ok = F.when(F.col("empty"), False).when(F.col("kind") == "NOT-YET", F.col("abstained") & clean).otherwise(F.col("hit") & clean)
    return rows.withColumn("ok", ok)


def arm_summary(rows: DataFrame) -> DataFrame:
    """Per arm and repetition: violation rates, correctness by kind, abstentions, engine failures."""
    mean = lambda c: F.avg(c.cast("int"))
    by_kind = lambda k: F.coalesce(F.try_divide(F.count_if((F.col("kind") == k) & F.col("ok")), F.count_if(F.col("kind") == k)), F.lit(0.0))
    return rows.groupBy("arm", "rep").agg(
        mean((F.col("bad_cites") > 0) & ~F.col("empty")).alias("cite_violation"), mean((F.col("leaks") > 0) & ~F.col("empty")).alias("num_violation"), mean(F.col("ok")).alias("correct"),
        *[by_kind(k).alias(n) for k, n in (("AVAILABLE", "available"), ("NOT-YET", "not_yet"), ("TRAP", "trap"))], mean(F.col("abstained")).alias("abstain_rate"), F.count_if("empty").alias("engine_fail"),
    )


def over_repetitions(summary: DataFrame, columns: list[str]) -> DataFrame:
    return summary.groupBy("arm").agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def traced_numbers(reports: DataFrame, body: str, fragments: str) -> DataFrame:
    """One row a number of each sentence: cited, and found among the cited or in any fragments (array)."""
    s = reports.select("*", F.posexplode(T.sentences(F.col(body))).alias("sentence_no", "sentence"))
    n = s.select("*", F.explode(T.numbers(F.col("sentence"), without_years=True)).alias("number"), T.citations(F.col("sentence")).alias("cites"))
    inside = F.exists(fragments, lambda f: T.found_in(f, F.col("number")))
    cited = F.exists(F.transform("cites", lambda j: F.get(F.col(fragments), j - 1)), lambda f: T.found_in(f, F.col("number")))
    return n.withColumns({"in_corpus": inside, "traceable": F.coalesce(cited, F.lit(False))})


def report_rates(reports: DataFrame, by: list[str], body: str, fragments: str) -> DataFrame:
    """Per group: numbers that are no years, those traced to their own sentence's
    citations and those found in any fragment, with rates (NULL without numbers);
    sentences, those with numbers that cite, and year tokens, which are apart."""
    s = reports.select(*by, fragments, F.explode(T.sentences(F.col(body))).alias("_s"))
    all_, own = T.numbers(F.col("_s")), T.numbers(F.col("_s"), without_years=True)
    counts = s.groupBy(*by).agg(F.count("*").alias("sentences"), F.count_if((F.size(all_) > 0) & (F.size(T.citations(F.col("_s"))) > 0)).alias("cited_sentences"), F.sum(F.size(all_) - F.size(own)).alias("years"))
    n = traced_numbers(reports, body, fragments).groupBy(*by).agg(F.count("*").alias("numbers"), F.count_if("traceable").alias("traced"), F.count_if("in_corpus").alias("in_corpus"))
    out = counts.join(n, by, "left").na.fill(0)
    return out.withColumns({"traced_rate": F.try_divide("traced", "numbers"), "corpus_rate": F.try_divide("in_corpus", "numbers")})
