"""Tables that are replaced by a commit: rows go to a folder of their own, and
only when they are complete and have passed their guards does a small numbered
file name it. Readers take the highest number, so a job that fails half-way
leaves the last version as it was, and of two writers that began from the same
version one fails.

Guards are aggregates that Spark observes while it writes: one run of the plan
both writes and checks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.writers import EmptyResult

COMMITS, DATA, KEPT = "_commits", "data", 2  # folders, and versions whose rows stay


class Refused(ValueError):
    """Rows that a guard doesn't accept."""


class Conflict(RuntimeError):
    """Another writer committed first."""


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def observed(df: DataFrame, guards: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """df whose next run also counts its rows and evaluates the guards
    (aggregates that must be true)."""
    seen = Observation()
    checks = [F.coalesce(c, F.lit(False)).alias(f"ok_{n}") for n, c in (guards or {}).items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *checks), seen


def check(seen: Observation, what: str) -> int:
    """How many rows there were; an error if none, or if a guard said no."""
    found = seen.get
    if not found["rows"]:
        raise EmptyResult(f"{what} is empty")
    if bad := [n.removeprefix("ok_") for n, ok in found.items() if n.startswith("ok_") and not ok]:
        raise Refused(f"{what}: {', '.join(bad)}")
    return found["rows"]


def versions(spark: SparkSession, root: str) -> list[dict]:
    """All commits in order: number, path, rows, format, keys."""
    fs, at = _files(spark, f"{root}/{COMMITS}")
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    rows = spark.read.text([f"{root}/{COMMITS}/{n}" for n in names if n.endswith(".json")], wholetext=True).collect() if any(n.endswith(".json") for n in names) else []
    return sorted((json.loads(r.value) for r in rows), key=lambda c: c["number"])


def publish(df: DataFrame, root: str, form: str = "parquet", keys: list[str] | None = None, guards: dict[str, Column] | None = None) -> dict:
    """Makes df the current version of the table at root, one subfolder a key.
    Raises EmptyResult, Refused or Conflict, or what the job raises; the version
    before is then still current, and the new rows are gone."""
    spark = df.sparkSession
    number = (past[-1]["number"] if (past := versions(spark, root)) else 0) + 1
    name = f"{DATA}/{number:010d}-{uuid.uuid4().hex}"
    fs, at = _files(spark, f"{root}/{name}")
    rows, seen = observed(df, guards)
    try:
        writer = rows.write.format(form).option("ignoreNullFields", False)
        (writer.partitionBy(*keys) if keys else writer).save(f"{root}/{name}")
        commit = {"number": number, "path": name, "rows": check(seen, root), "format": form, "keys": keys or []}
        _, draft = _files(spark, f"{root}/{COMMITS}/.{uuid.uuid4().hex}")
        _, place = _files(spark, f"{root}/{COMMITS}/{number:010d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Conflict(f"{root}: version {number} is there already")
    except BaseException:
        fs.delete(at, True)
        raise
    for old in past[: max(0, len(past) + 1 - KEPT)]:  # readers of the version before may still be at work
        fs.delete(_files(spark, f"{root}/{old['path']}")[1], True)
    return commit


def current(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The rows of the last commit."""
    if not (past := versions(spark, root)):
        raise FileNotFoundError(f"{root} has no version")
    last = past[-1]
    reader = spark.read.format(last["format"])
    return (reader.schema(schema) if schema is not None else reader).load(f"{root}/{last['path']}")
