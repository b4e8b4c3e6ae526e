"""The corpus pipeline: quality rules, near-duplicates, benchmark passages,
personal data, packing. Each stage takes what the one before it kept.

Null and empty texts fail the quality rules. Repeated rows are copies, of which
the near-duplicate stage keeps one; ties are the operators' own. Very long texts
take the same way as others. Columns besides doc_id, text and lang are carried
up to packing, whatever their names. An empty table gives no pieces. Each stage
but the last is a table in the shared folder, so a lost executor costs a stage
at most; a table goes when the stage after it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, near_dedup, packing, pseudonyms, quality, queries, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(docs, verdict="quality_verdict")
    return judged.where("quality_verdict.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; n_chars follows."""
    out = pseudonyms.pseudonymise(docs, queries.run_key(spark))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    out = packing.pack(docs, end_id=1, payload=F.crc32("ids"))
    return out.select("doc_id", "start", "length", F.col("payload").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark passages", benchmark_passages),
    ("personal data", personal_data),
    ("packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
