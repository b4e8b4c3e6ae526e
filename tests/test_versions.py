"""Tables that are replaced by a commit, and guards in the run that writes."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import pit
from plumbline.sources import readers, versions
from plumbline.sources import writers as W


def counted(spark, df):
    """df that counts how often each of its rows is worked out."""
    runs = spark.sparkContext.accumulator(0)

    def touch(x):
        runs.add(1)
        return x

    return df.withColumn("v", F.udf(touch, "long")("v")), runs


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "v").collect())


@pytest.fixture
def first(spark):
    return spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))


def test_a_failed_write_leaves_the_last_version(spark, tmp_path, first):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, root)
    assert versions.publish(first, root)["number"] == 1
    want = rows(first)
    half = first.withColumn("v", F.when(F.col("v") == 99, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("v") + 1)).repartition(8)
    with pytest.raises(Exception, match="half-way"):
        versions.publish(half, root)
    with pytest.raises(W.EmptyResult):
        versions.publish(first.limit(0), root)
    with pytest.raises(versions.Refused, match="small"):
        versions.publish(first, root, guards={"small": F.max("v") < 99, "whole": F.count("*") == 100})
    assert rows(versions.current(spark, root)) == want
    assert len(os.listdir(f"{root}/data")) == 1 and [v["rows"] for v in versions.versions(spark, root)] == [100]


def test_versions_follow_each_other(spark, tmp_path, first):
    root = str(tmp_path / "t")
    for n in range(1, 5):
        open_before = versions.current(spark, root) if n > 1 else None
        assert versions.publish(first.withColumn("v", F.col("v") + n), root, "json", ["k"])["number"] == n
        if open_before is not None:
            assert rows(open_before) == rows(first.withColumn("v", F.col("v") + n - 1))  # a reader of the version before
    assert rows(versions.current(spark, root, "v long, k long")) == rows(first.withColumn("v", F.col("v") + 4))
    assert len(os.listdir(f"{root}/data")) == versions.KEPT


def test_one_of_two_writers_loses(spark, tmp_path, first, monkeypatch):
    root, real = str(tmp_path / "t"), versions.check

    def late(seen, what):
        monkeypatch.setattr(versions, "check", real)
        versions.publish(first.limit(7), root)
        return real(seen, what)

    versions.publish(first, root)
    monkeypatch.setattr(versions, "check", late)
    with pytest.raises(versions.Conflict):
        versions.publish(first.limit(9), root)
    assert versions.current(spark, root).count() == 7 and len(os.listdir(f"{root}/data")) == 2


def test_the_plan_runs_once(spark, tmp_path, first):
    for n, write in enumerate((lambda df: versions.publish(df, f"{tmp_path}/a", guards={"all": F.count("*") == 100}), lambda df: W.json(df, f"{tmp_path}/b"), lambda df: W.csv(df, f"{tmp_path}/c"), lambda df: W.per_entity(df, f"{tmp_path}/d", ["k"]), lambda df: W.document(df, f"{tmp_path}/e"))):
        df, runs = counted(spark, first)
        write(df)
        assert runs.value == 100, n


def test_an_empty_result_leaves_what_was_there(spark, tmp_path, first):
    path = f"{tmp_path}/out"
    W.json(first, path)
    for bad, error in ((first.limit(0), W.EmptyResult), (first.withColumn("v", F.raise_error(F.lit("broken")).cast("long")), Exception)):
        with pytest.raises(error):
            W.json(bad, path)
    assert rows(spark.read.json(path)) == rows(first) and os.listdir(tmp_path) == ["out"]
    W.json(first.limit(5), path)
    assert spark.read.json(path).count() == 5


def test_an_empty_calendar_is_an_error(spark):
    facts = spark.createDataFrame([("2024-01-01", "2024-01-05")], "p string, a string").select(F.to_date("p").alias("p"), F.to_date("a").alias("a"))
    none = facts.select(F.col("p").alias("day")).limit(0)
    with pytest.raises(Exception, match="no day"):
        pit.windows(facts, none, "p", "a").collect()
    with pytest.raises(Exception, match="no day"):
        pit.window_statistics(facts.withColumn("trade_days", F.lit(1)), none, none).collect()


def test_a_key_that_no_source_has_is_an_error(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 0), (2, "c", 2)], "k int, source string, r int")
    wanted = spark.createDataFrame([(1,), (2,)], "k int")
    assert {r.k: r.source for r in readers.first_source(df, ["k"], F.col("r"), wanted).collect()} == {1: "a", 2: "c"}
    with pytest.raises(Exception, match="no source has 3"):
        readers.first_source(df, ["k"], F.col("r"), wanted.union(spark.createDataFrame([(3,)], "k int"))).collect()
