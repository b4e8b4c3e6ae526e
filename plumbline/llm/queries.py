"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, fill_in_middle, html_text, language_id, language_model, near_dedup, packing, pseudonyms, quality, resampling, substring_dedup, token_files, warc
from plumbline.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_key(spark: SparkSession) -> str:
    """The configured key of pseudonyms; where none is set, as in tests and
    checks, one of this process alone, so that nobody can undo its pseudonyms."""
    if not spark.conf.get(pseudonyms.KEY_SETTING, None):
        spark.conf.set(pseudonyms.KEY_SETTING, secrets.token_hex(32))
    return pseudonyms.configured_key(spark)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), run_key(spark), found="n_found").select("doc_id", "text", "n_found")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), end_id=1, payload=F.crc32("ids"))
    return out.select("doc_id", "start", "length", F.col("payload").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.read(warc.write(_table(spark, sf_dir, "pages")))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(_table(spark, sf_dir, "documents"), end_id=0)
    return token_files.read(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.sampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    out = language_id.identify(docs, ~held_out, into="found")
    return out.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(_table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("fim.output"), F.col("fim.form"))
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_model, op2_pseudonyms, op3_quality, op4_substring_dedup, op5_near_dedup, op6_decontaminate, op7_packing, op8_html_text, op9_warc, op10_token_files, op11_resampling, op12_language_id, op13_fill_in_middle)
}
