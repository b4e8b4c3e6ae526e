"""Readers: daily bars, announcements, manifests, corpora, statement tables, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BARS_A = "`日期` DATE, `股票代码` STRING, `开盘` DOUBLE, `收盘` DOUBLE, `最高` DOUBLE, `最低` DOUBLE, `成交量` BIGINT, `成交额` DOUBLE, `振幅` DOUBLE, `涨跌幅` DOUBLE, `涨跌额` DOUBLE, `换手率` DOUBLE"
BARS_B = "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, amount DOUBLE, outstanding_share DOUBLE, turnover DOUBLE"
ANNOUNCEMENTS = "`代码` STRING, `简称` STRING, `公告标题` STRING, `公告时间` STRING, `公告链接` STRING"
TABLE = "label STRING, scope STRING, pages ARRAY<INT>, header ARRAY<STRING>, rows ARRAY<STRUCT<label STRING, vals ARRAY<DOUBLE>>>, unit STRING, `table` STRING, period STRING, announced DATE, source STRING, title STRING, symbol STRING, short STRING, kind STRING"


def daily_bars(spark: SparkSession, path: str, vendor: str = "a") -> DataFrame:
    """(date, close) and all other columns of a vendor's daily bars."""
    df = spark.read.option("header", True).schema(BARS_A if vendor == "a" else BARS_B).csv(path)
    return df.withColumnsRenamed({"日期": "date", "收盘": "close", "股票代码": "code"}) if vendor == "a" else df


def announcements(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).schema(ANNOUNCEMENTS).csv(path)
    return df.select(F.col("代码").alias("code"), F.col("简称").alias("name"), F.col("公告标题").alias("title"), F.to_date(F.try_to_timestamp(F.substring("公告时间", 1, 10), F.lit("yyyy-MM-dd"))).alias("announced"), F.col("公告链接").alias("url"))


def resolve(df: DataFrame, *parts: str) -> str:
    """The first column whose name contains one of the parts, most specific part first."""
    for part in parts:
        for c in df.columns:
            if part.lower() in c.lower():
                return c
    raise ValueError(f"none of {parts} in {df.columns}")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): whole text files by name."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def statement_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def longest_consolidated(tables: DataFrame) -> DataFrame:
    """Of each symbol and statement the longest consolidated table; the first file wins ties."""
    w = Window.partitionBy("symbol", "label").orderBy(F.size("rows").desc(), "file")
    return tables.where(F.col("scope").startswith("合并")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def statement_lines(tables: DataFrame) -> DataFrame:
    """One row per cell: (file, symbol, period, stmt, row_idx, label_raw, col_idx, header_text, value, unit)."""
    rows = tables.select("file", "symbol", "period", F.col("label").alias("stmt"), "header", "unit", F.posexplode_outer("rows").alias("row_idx", "row"))
    cells = rows.select("file", "symbol", "period", "stmt", "unit", "header", "row_idx", F.col("row.label").alias("label_raw"), F.posexplode_outer("row.vals").alias("col_idx", "value"))
    return cells.withColumn("header_text", F.get("header", F.col("col_idx") + 1)).drop("header")


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """(stmt, concept, alias, ord): a dictionary's aliases, each concept's own name first."""
    kind = "map<string, array<string>>"
    raw = spark.read.schema(f"BS {kind}, IS {kind}, CF {kind}").option("multiLine", True).json(path)
    by = raw.select(F.explode(F.create_map(*[x for s in ("BS", "IS", "CF") for x in (F.lit(s), F.col(s))])).alias("stmt", "own"))
    named = by.select("stmt", F.posexplode(F.map_entries("own")).alias("n", "e"))
    return named.select("stmt", F.col("e.key").alias("concept"), "n", F.posexplode(F.concat(F.array("e.key"), "e.value")).alias("k", "alias")).withColumn("ord", F.col("n") * 1000 + F.col("k")).drop("n", "k")


def attributed_log(lines: DataFrame, order: str, text: str, summary: str, warning: str, file: str) -> DataFrame:
    """Warnings (regex with one group or more) of logs with the next summary
    line's first group in the same file; warnings after the last summary are dropped."""
    key = F.nullif(F.regexp_extract(text, summary, 1), F.lit(""))
    marked = lines.withColumn("key", key)
    following = Window.partitionBy(file).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return marked.withColumn("owner", F.first("key", ignorenulls=True).over(following)).where(F.col(text).rlike(warning) & F.col("owner").isNotNull() & F.col("key").isNull())


def constituents(sources: list[DataFrame], fallback: DataFrame) -> DataFrame:
    """Members of an index (code, name, source): the first source with any row,
    else a table that ships; of a code named twice the first name in order."""
    ranked = [df.select(F.col("code").cast("string"), "name", F.lit(k).alias("source")) for k, df in enumerate([*sources, fallback])]
    every = ranked[0]
    for df in ranked[1:]:
        every = every.unionByName(df)
    best = every.agg(F.min("source").alias("source"))
    return every.join(F.broadcast(best), "source").groupBy("code", "source").agg(F.min("name").alias("name"))


def cached(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(what a cache partitioned by keys holds of the wanted keys, what is still to be fetched)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None, wanted
    # the keys' own types, as types guessed from folders' names lose leading zeros
    schema = StructType([StructField(f.name, wanted.schema[f.name].dataType if f.name in keys else f.dataType) for f in spark.read.parquet(path).schema])
    held = spark.read.schema(schema).parquet(path)
    return held.join(wanted.select(*keys), keys, "left_semi"), missing(wanted, held.select(*keys), keys)


def valid_files(files: DataFrame, magic: str = "%PDF", least: int = 1_500_000) -> DataFrame:
    """Rows of a binaryFile source with the right first bytes and size."""
    return files.where((F.substring("content", 1, len(magic)).cast("string") == magic) & (F.length("content") >= least))


def first_source(df: DataFrame, keys: list[str], rank: Column, wanted: DataFrame | None = None) -> DataFrame:
    """Of each key the row of the best source: cached first, then by vendor
    order. With wanted (keys), a key that no source has fails the run."""
    if wanted is not None:
        found = df.withColumn("_rank", rank)
        all_ = wanted.select(*keys).distinct().join(found, keys, "left")
        lost = F.raise_error(F.concat_ws(" ", F.lit("no source has"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
        return first_source(all_.where(F.when(F.col("_rank").isNull(), lost).otherwise(True)), keys, F.col("_rank")).drop("_rank")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(rank))).where("_n = 1").drop("_n")


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be fetched."""
    return wanted.join(present, keys, "left_anti")
