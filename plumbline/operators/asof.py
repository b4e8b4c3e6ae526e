"""Answers as of a date: retrieval arms, and violations found in the answers' own texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import patterns, postings
from plumbline.operators.joins import small
from plumbline.sources.staging import staged

ARMS = ("A", "B", "C", "D")  # no constraint, by instruction, by filter, by filter and inventory


def arms(questions: DataFrame, chunks: DataFrame, announced: str = "announced") -> DataFrame:
    """(arm, as_of) for each arm and date of the questions, joined with the
    chunks that its retrieval may see: all for A and B, those announced by the
    date for C and D. Count bigrams after this, per arm and date."""
    dates = questions.select("as_of").distinct()
    every = dates.crossJoin(questions.sparkSession.createDataFrame([(a,) for a in ARMS], "arm string"))
    free = F.col("arm").isin("A", "B")
    return chunks.join(small(every), free | (F.col(announced) <= F.col("as_of")))


def arm_picks(index: postings.Index, questions: DataFrame, keys: list[str], question: str = "question", k: int = 6) -> DataFrame:
    """(keys, as_of, arm, rank, the index's ids, announced, score): the k best
    chunks that each arm retrieves. A and B search all chunks with the weights of
    all; C and D those announced by the question's date with the weights of that
    date. One index and two searches a question serve the four arms."""
    pools = F.array(F.struct(F.lit("AB").alias("pool"), F.lit(None).cast("date").alias("until")), F.struct(F.lit("CD").alias("pool"), F.col("as_of").cast("date").alias("until")))
    asked = questions.where("as_of is not null").select(*keys, "as_of", question, F.explode(pools).alias("_p")).select(*keys, "as_of", question, "_p.*")
    # answers, citations and verdicts all read what is found, so the search runs once
    found = staged(postings.search(index, asked, [*keys, "as_of", "pool"], question, k, as_of="until"), "picks")
    return found.withColumn("arm", F.explode(F.split("pool", ""))).drop("pool")


def inventory(manifest: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, inventory): what is disclosed by each date, as lines in order of announcement."""
    seen = manifest.join(small(dates.select("as_of").distinct()), F.col("announced") <= F.col("as_of"))
    line = F.struct("announced", F.concat(F.lit("- "), F.col("title"), F.lit("（公告日 "), F.col("announced").cast("string"), F.lit("）")).alias("line"))
    return seen.groupBy("as_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("inventory"))


def bad_citations(answers: DataFrame, picked: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, bad_cites): citations of fragments that were announced after the
    answer's date. picked: (ids, rank, announced)."""
    cited = answers.select(*ids, "as_of", F.explode(T.citations(F.col("answer"), tight=True)).alias("rank"))
    late = cited.join(picked, [*ids, "rank"]).where(F.col("announced") > F.col("as_of"))
    return late.groupBy(*ids).agg(F.count("*").alias("bad_cites"))


def stated_numbers(answers: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, as_of, number): numbers of an answer that are no years and don't come from its question."""
    own = F.array_except(F.array_distinct(T.numbers(F.col("answer"), without_years=True)), T.numbers(F.col("question")))
    return answers.select(*ids, "as_of", F.explode(own).alias("number"))


def ways_of_writing(numbers: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, number, way): every way in which a number may be written."""
    return numbers.select(*ids, "number", F.explode(T.variants(F.col("number"))).alias("way"))


def documents_with(numbers: DataFrame, documents: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, number, doc, announced): documents whose text without blanks and
    commas contains a number in any of its ways. All ways are looked for at
    once, so each text is read once."""
    ways = ways_of_writing(numbers, ids)
    bare = documents.select("doc", "announced", T.squeezed(F.col("text"), "").alias("_bare"))
    held = patterns.containing(bare, ["doc", "announced"], "_bare", ways, "way")
    return ways.join(held, "way").select(*ids, "number", "doc", "announced").distinct()


def leaked_numbers(answers: DataFrame, documents: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, leaks): numbers of an answer that documents hold, but none that was announced by its date."""
    own = stated_numbers(answers, ids)
    ways = ways_of_writing(own, ids)
    first = patterns.earliest(documents.select("announced", T.squeezed(F.col("text"), "").alias("_bare")), "_bare", "announced", ways, "way")
    found = ways.join(first, "way").groupBy(*ids, "number").agg(F.min("first").alias("first"))
    late = own.join(found, [*ids, "number"]).where(F.col("first") > F.col("as_of"))
    return late.groupBy(*ids).agg(F.count("*").alias("leaks"))


def judged(answers: DataFrame, picked: DataFrame, documents: DataFrame, ids: list[str]) -> DataFrame:
    """Answers (ids, arm, rep, kind, as_of, question, answer, expect) with
    bad_cites, leaks, abstained, hit, empty and ok, all from their texts."""
    from plumbline.operators.retrieval import judged as verdict

    empty = F.trim(F.coalesce("answer", F.lit(""))) == ""
    bare = F.replace("answer", F.lit(","), F.lit(""))
    hit = F.exists("expect", lambda e: F.exists(T.variants(e), lambda v: F.contains(bare, v)))
    rows = answers.join(bad_citations(answers, picked, ids), ids, "left").join(leaked_numbers(answers, documents, ids), ids, "left")
    rows = rows.withColumns({"bad_cites": F.coalesce("bad_cites", F.lit(0)), "leaks": F.coalesce("leaks", F.lit(0)), "abstained": F.coalesce(T.abstains(F.col("answer"), as_of=True), F.lit(False)), "hit": F.coalesce(hit, F.lit(False)), "empty": empty})
    return verdict(rows)
