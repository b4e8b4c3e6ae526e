"""Where operators put tables that cut lineage, and how they size their exchanges.

Everything goes below ``spark.checkpoint.dir``, the folder that driver and
executors share. The setting is read from the session; only where it is unset
and Spark runs in one local process (tests, notebooks) a temporary folder is
made and set.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back: later steps no longer depend on
    the shuffles behind df, so a lost executor costs one step at most."""
    spark = df.sparkSession
    path, schema = new_path(spark, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    collect_garbage(spark)
    return spark.read.schema(schema).parquet(path)


PAUSE = 2  # seconds between two collections at least
_last = 0.0


def collect_garbage(spark: SparkSession, at_once: bool = False) -> None:
    """Shuffle files of finished steps go only after the driver's garbage is
    collected; steps that follow closely wait for one collection, unless it is
    asked for at once."""
    global _last
    if at_once or time.monotonic() - _last >= PAUSE:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _last = time.monotonic()


def discard(df: DataFrame) -> None:
    """Deletes the table of a staged DataFrame whose last reader is done."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/plumbline/"
    files = df.inputFiles()
    if files:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if root.split(":", 1)[-1].lstrip("/") in str(at.toString()):
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def buckets_for(spark: SparkSession, payload_bytes: int, each: int = 32 << 20) -> int:
    """How many buckets keep one bucket's payload near ``each`` bytes, and no
    fewer than the session's shuffle partitions so that all cores have work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-payload_bytes // each))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()[0]
