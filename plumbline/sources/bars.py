"""Daily bars of many symbols from ordered sources, as a Spark data source.

A partition is one symbol and adjustment, so that what fails is tried again by
itself. Within it the sources are asked in order, each a number of times; if
none has a readable file the read fails and says why. Filters on symbol and
adjustment reach the list of partitions, so files that aren't wanted aren't
opened. What was read goes to a cache partitioned by both, and a later read
asks for what is missing only."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from plumbline.sources import readers, writers

NAME = "daily_bars"
SCHEMA = "symbol string, adj string, source string, date date, close double"
# The vendors' names of the two columns.
COLUMNS = {"a": ("日期", "收盘"), "b": ("date", "close")}
MOST = 100_000  # symbols times adjustments of one read


class Bars(InputPartition):
    def __init__(self, symbol: str, adj: str):
        super().__init__((symbol, adj))
        self.symbol, self.adj = symbol, adj


class BarsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = [tuple(s) for s in json.loads(options["sources"])]  # (name, vendor, folder) in order
        self.wanted = [tuple(w) for w in json.loads(options["wanted"])]
        self.tries, self.wait = int(options.get("tries", "2")), float(options.get("wait", "0"))
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of the two keys, leaves the rest to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in ("symbol", "adj"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Bars]:
        keep = lambda name, v: name not in self.only or v in self.only[name]
        return [Bars(s, a) for s, a in self.wanted if keep("symbol", s) and keep("adj", a)]

    def read(self, partition: Bars | None) -> Iterator[tuple]:
        if partition is None:  # nothing is wanted
            return
        failed = []
        for name, vendor, folder in self.sources:
            for attempt in range(self.tries):
                try:
                    dates, closes = bars(f"{folder}/{partition.symbol}_{partition.adj}.csv", vendor)
                except Exception as e:  # whatever a source does, the next one may do better
                    failed.append(f"{name}: {type(e).__name__} {e}")
                    if attempt + 1 < self.tries:
                        time.sleep(self.wait)
                    continue
                yield from ((partition.symbol, partition.adj, name, d, c) for d, c in zip(dates, closes))
                return
        raise OSError(f"no source has {partition.symbol} {partition.adj or 'unadjusted'}: {'; '.join(failed)}")


class BarsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarsReader:
        return BarsReader(self.options)


def bars(path: str, vendor: str) -> tuple[list, list]:
    """Dates and closes of a vendor's file, by any path that Arrow opens; a file without rows is an error."""
    import pyarrow as pa
    from pyarrow import csv, fs

    files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    date, close = COLUMNS[vendor]
    with files.open_input_stream(at) as raw:
        table = csv.read_csv(raw, convert_options=csv.ConvertOptions(include_columns=[date, close], column_types={date: pa.date32(), close: pa.float64()}))
    if not table.num_rows:
        raise ValueError("no rows")
    return table[date].to_pylist(), table[close].to_pylist()


def read(spark: SparkSession, sources: list[tuple[str, str, str]], wanted: list[tuple[str, str]], tries: int = 2, wait: float = 0) -> DataFrame:
    """(symbol, adj, source, date, close) of all wanted symbols and adjustments."""
    if len(wanted) > MOST:
        raise ValueError(f"more than {MOST} symbols times adjustments in one read")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(BarsSource)
    return spark.read.format(NAME).options(sources=json.dumps(sources), wanted=json.dumps(wanted), tries=str(tries), wait=str(wait)).load()


def resumed(spark: SparkSession, sources: list[tuple[str, str, str]], wanted: DataFrame, cache: str, **options) -> DataFrame:
    """Like ``read`` for wanted (symbol, adj), through a cache: only what it
    lacks is read and added, each symbol and adjustment by itself whole."""
    keys = ["symbol", "adj"]
    _, rest = readers.cached(spark, cache, wanted, keys)
    todo = [tuple(r) for r in rest.select(*keys).distinct().limit(MOST + 1).collect()]
    if todo:
        writers.partitions(read(spark, sources, todo, **options), cache, keys)
    held, _ = readers.cached(spark, cache, wanted, keys)
    return held.select(*[F.col(c.split()[0]) for c in SCHEMA.split(", ")])
