"""Warnings of growing logs with the summary line that follows them, as a stream,
and run logs that a restart doesn't write twice.

The batch form (``readers.attributed_log``) looks forward in a file. A stream
can't, so each file's open warnings are held as state until their summary comes,
whatever the bounds of micro-batches; those after the last summary stay open.
Lines of a file must come in order of batches; within a batch they are sorted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KIND = "file string, n long, text string, owner string"


class Open(StatefulProcessor):
    """Holds the warnings of one file until their summary line."""

    def __init__(self, summary: str, warning: str):
        self.summary, self.warning = summary, warning

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "n long, text string")
        self.is_summary, self.is_warning = re.compile(self.summary).search, re.compile(self.warning).search

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("n")
        held, out, kept = [tuple(r) for r in self.held.get()], [], 0
        for n, text in zip(new["n"], new["text"]):
            if (m := self.is_summary(text)) and m.group(1):
                out += [(key[0], k, t, m.group(1)) for k, t in held[kept:]]
                kept = len(held)
            elif self.is_warning(text):
                held.append((int(n), text))
        if kept:
            self.held.clear()
        if kept < len(held):
            self.held.put(held[kept:])
        yield pd.DataFrame(out, columns=["file", "n", "text", "owner"])

    def close(self) -> None:
        pass


def attributed(lines: DataFrame, summary: str, warning: str) -> DataFrame:
    """(file, n, text, owner) of each warning (a regex) once the next summary
    line of its file has come; owner is the summary's first group. lines: a
    stream of (file, n, text). Needs the RocksDB state store."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = lines.select("file", F.col("n").cast("long"), "text").where("text is not null")
    return rows.groupBy("file").transformWithStateInPandas(statefulProcessor=Open(summary, warning), outputStructType=KIND, outputMode="Append", timeMode="None")


def run_log(path: str):
    """For ``foreachBatch``: adds each micro-batch to a log, partitioned by its
    number. A batch that is given again after a restart replaces its own rows."""

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)

    return write
