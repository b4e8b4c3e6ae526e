"""The data source of daily bars, and the stream that attributes warnings."""

import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import bars, readers
from plumbline.streaming import attribution


@pytest.fixture
def sources(tmp_path):
    for name in ("first", "second"):
        os.makedirs(tmp_path / name)
    put = lambda at, text: (tmp_path / at).write_text(text, encoding="utf-8")
    put("first/600519_.csv", "日期,股票代码,开盘,收盘\n2024-01-02,600519,1.0,1685.01\n2024-01-03,600519,1.0,1694.0\n")
    put("second/600519_.csv", "date,open,close\n2024-01-02,1,1.5\n")
    put("first/600519_qfq.csv", "日期,收盘\nnot a date,1\n")
    put("second/600519_qfq.csv", "date,open,close\n2024-01-02,1,2.5\n")
    put("second/000001_.csv", "date,close\n2024-01-04,9.5\n")
    put("first/000002_.csv", "日期,收盘\n")
    return [("one", "a", f"{tmp_path}/first"), ("two", "b", f"{tmp_path}/second")]


def test_sources_in_order(spark, sources):
    wanted = [("600519", ""), ("600519", "qfq"), ("000001", "")]
    df = bars.read(spark, sources, wanted)
    assert sorted((r.symbol, r.adj, r.source, str(r.date), r.close) for r in df.collect()) == [("000001", "", "two", "2024-01-04", 9.5), ("600519", "", "one", "2024-01-02", 1685.01), ("600519", "", "one", "2024-01-03", 1694.0), ("600519", "qfq", "two", "2024-01-02", 2.5)]
    assert df.rdd.getNumPartitions() == 3
    for missing in ("000002", "999999"):
        with pytest.raises(Exception, match=f"no source has {missing}"):
            bars.read(spark, sources, [*wanted, (missing, "")]).collect()
    assert bars.read(spark, sources, []).count() == 0


def test_filters_reach_the_partitions(spark, sources):
    wanted = [("600519", ""), ("600519", "qfq"), ("999999", "")]
    df = bars.read(spark, sources, wanted)
    assert df.where("symbol = '600519' and adj = ''").count() == 2  # 999999 would fail
    assert df.where("symbol in ('600519', 'x') and close > 1690").count() == 1
    assert df.where("adj = 'qfq'").rdd.getNumPartitions() == 1


def test_resumed_reads_touch_what_is_missing(spark, sources, tmp_path):
    cache = f"{tmp_path}/cache"
    wanted = spark.createDataFrame([("600519", "qfq"), ("000001", "raw")], "symbol string, adj string")
    os.rename(f"{tmp_path}/second/000001_.csv", f"{tmp_path}/second/000001_raw.csv")
    assert bars.resumed(spark, sources, wanted.limit(1), cache).count() == 1
    os.remove(f"{tmp_path}/second/600519_qfq.csv")  # it is held, so nobody asks for it
    got = bars.resumed(spark, sources, wanted, cache)
    assert sorted((r.symbol, r.adj, r.close) for r in got.collect()) == [("000001", "raw", 9.5), ("600519", "qfq", 2.5)]


def log(rng, n):
    return [rng.choice([f"警告 {i} 列宽", f"== {rng.randrange(100):06d} 完成", "正文"]) for i in range(n)]


def test_warnings_across_batches(spark, tmp_path):
    rng = random.Random(5)
    files = {f"f{k}": log(rng, 40) for k in range(4)}
    every = [(f, n, t) for f, own in files.items() for n, t in enumerate(own)]
    batch = spark.createDataFrame(every, "file string, n long, text string")
    want = sorted((r.file, r.n, r.text, r.owner) for r in readers.attributed_log(batch, "n", "text", r"== (\d{6})", "警告", "file").collect())
    assert len(want) > 30
    for run, size in enumerate((1000, 7)):
        source, out, state = (f"{tmp_path}/{x}{run}" for x in ("in", "out", "state"))
        os.makedirs(source)

        def start():
            lines = spark.readStream.schema("file string, n long, text string").option("maxFilesPerTrigger", 1).json(source)
            query = attribution.attributed(lines, r"== (\d{6})", "警告").writeStream.foreachBatch(attribution.run_log(out)).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()

        pieces = [[(f, n, t) for f, n, t in every if n // size == k] for k in range(-(-40 // size))]
        for k, piece in enumerate(pieces):
            tmp = f"{tmp_path}/piece"
            spark.createDataFrame(piece, "file string, n long, text string").coalesce(1).write.mode("overwrite").json(tmp)
            part = next(x for x in os.listdir(tmp) if x.endswith(".json"))
            os.rename(f"{tmp}/{part}", f"{source}/{k:03d}.json")
            if k == len(pieces) // 2:
                start()  # then a restart goes on with the state
        start()
        start()
        assert sorted((r.file, r.n, r.text, r.owner) for r in spark.read.json(out).collect()) == want


def test_a_batch_given_again_is_written_once(spark, tmp_path):
    write, path = attribution.run_log(f"{tmp_path}/log"), f"{tmp_path}/log"
    for number, n in ((0, 3), (1, 4), (1, 4)):
        write(spark.range(n).withColumn("arm", F.lit("A")), number)
    assert spark.read.json(path).count() == 7
