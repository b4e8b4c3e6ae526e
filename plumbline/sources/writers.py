"""Writers, guards and fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class EmptyResult(ValueError):
    """An empty output is an error, not a result."""


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """df, after a look for its first row; where df is written anyway,
    ``replaced`` counts while it writes."""
    if df.isEmpty():
        raise EmptyResult(f"{what} is empty")
    return df


BOM = "\ufeff"


def replaced(df: DataFrame, path: str, write) -> None:
    """Writes rows beside path and puts them in its place when they are complete
    and not none, in one run of df; else what was there stays."""
    jvm, hidden = df.sparkSession.sparkContext._jvm, path.rstrip("/").rpartition("/")
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    beside = f"{hidden[0]}/.{hidden[2]}-{uuid.uuid4().hex}" if hidden[1] else f".{path}-{uuid.uuid4().hex}"
    seen = Observation()
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")), beside)
        if not seen.get["rows"]:
            raise EmptyResult(f"{path} is empty")
        fs.delete(at(path), True)
        fs.rename(at(beside), at(path))
    finally:
        fs.delete(at(beside), True)


def csv(df: DataFrame, path: str) -> None:
    """CSV whose files start with a byte order mark, as spreadsheets want it."""
    first = df.columns[0]
    replaced(df, path, lambda rows, to: rows.withColumnRenamed(first, BOM + first).write.option("header", True).csv(to))


def json(df: DataFrame, path: str) -> None:
    replaced(df, path, lambda rows, to: rows.write.option("ignoreNullFields", False).json(to))


def document(df: DataFrame, path: str) -> None:
    """One indented JSON document of all rows, for results that a person reads."""

    def write(rows: DataFrame, to: str) -> None:
        every = F.to_json(F.array_agg(F.struct(*[F.col(c) for c in df.columns])), {"pretty": "true", "ignoreNullFields": "false"})
        rows.coalesce(1).agg(every.alias("value")).write.text(to)

    replaced(df, path, write)


def partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Adds to a cache partitioned by keys, or replaces the partitions it has."""
    non_empty(df, path).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_runs(df: DataFrame, path: str) -> None:
    """One JSON line a run, added to those there."""
    df.write.mode("append").json(path)


def per_entity(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces all files of a folder, one subfolder a key. Where readers come
    at any time, take ``versions.publish``."""
    replaced(df, path, lambda rows, to: rows.write.partitionBy(*keys).json(to))


def fingerprint(content: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(content, 256), 1, digits)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table for a person to read; longer results are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one table")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
