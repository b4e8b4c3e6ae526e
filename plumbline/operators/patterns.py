"""Many patterns in many texts: one automaton of all patterns passes over each
text once, whatever their number.

Patterns are sent to the workers in blocks whose size is checked; each block is
one pass over the texts. Null patterns and texts match nothing; the empty
pattern is in every text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import dealt, small, union

CHARACTERS = 1 << 22  # of the patterns of one automaton


def automaton(patterns: list[str]):
    """Gives the number of each pattern at its end; without the empty one."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        if p:
            out.add_word(p, i)
    out.make_automaton()
    return out


def finder(patterns: list[str]) -> Callable[[str], set[int]]:
    """Numbers of the patterns that a text contains. Patterns are distinct."""
    own = automaton(patterns)
    always = {i for i, p in enumerate(patterns) if not p}
    if not len(own):
        return lambda text: set(always)
    return lambda text: {i for _, i in own.iter(text)} | always


def blocks(patterns: DataFrame, pattern: str) -> Iterator[list[str]]:
    """The distinct patterns in blocks of bounded size."""
    some, size = [], 0
    for row in patterns.select(F.col(pattern)).where(F.col(pattern).isNotNull()).distinct().toLocalIterator():
        some.append(row[0])
        size += len(row[0])
        if size >= CHARACTERS:
            yield some
            some, size = [], 0
    if some:
        yield some


def _passes(texts: DataFrame, patterns: DataFrame, pattern: str, run, schema: str) -> DataFrame:
    spark = texts.sparkSession
    out = [texts.mapInArrow(run(spark.sparkContext.broadcast(some)), schema) for some in blocks(patterns, pattern)]
    return union(out) if out else spark.createDataFrame([], schema)


def containing(texts: DataFrame, keys: list[str], text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(keys, pattern): each text with each distinct pattern that it contains."""

    def run(shared):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, find = shared.value, None
            for batch in batches:
                find = find or finder(names)
                at, of = [], []
                for row, t in enumerate(batch.column("_text").to_pylist()):
                    own = find(t) if t is not None else ()
                    at += [row] * len(own)
                    of += own
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(at, pa.int64())) for k in keys], pa.array([names[i] for i in of], pa.string())], [*keys, pattern])

        return found

    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return _passes(texts.select(*keys, F.col(text).alias("_text")), patterns, pattern, run, f"{schema}, `{pattern}` string")


def earliest(texts: DataFrame, text: str, day: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, first): the first day of a text that contains the pattern. Each
    task sends one row a pattern at most; patterns found nowhere have none."""

    def run(shared):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, find, first = shared.value, None, {}
            for batch in batches:
                find = find or finder(names)
                for t, d in zip(batch.column("_text").to_pylist(), batch.column("_day").to_pylist()):
                    for i in find(t) if t is not None else ():
                        if i not in first or d < first[i]:
                            first[i] = d
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in first], pa.string()), pa.array(list(first.values()), pa.date32())], [pattern, "first"])

        return found

    dated = texts.select(F.col(text).alias("_text"), F.col(day).cast("date").alias("_day")).where("_day is not null")
    return _passes(dated, patterns, pattern, run, f"`{pattern}` string, first date").groupBy(pattern).agg(F.min("first").alias("first"))


def fuzzy(rows: DataFrame, slots: DataFrame, group: list[str], label: str = "label_norm", order: str = "row_idx") -> DataFrame:
    """For each group and slot (slot, name) the row whose label equals the
    name, else the one with the shortest label containing it, first row first.
    Names are looked for in the distinct labels only, which a frequent label
    mustn't gather in one task: rows stay dealt by group where these are few."""
    met = containing(rows.select(label).distinct(), [label], label, slots, "name")
    pairs = dealt(rows, group).join(small(met), label).join(small(slots), "name")
    w = Window.partitionBy(*group, "slot").orderBy((F.col(label) == F.col("name")).desc(), F.char_length(label), order)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
