"""Packing into fixed-length sequences as a cutting-stock problem.

Documents are tokenised and cut into full pieces of ``capacity`` ids and a
rest. Rests fall into classes by length, rounded up to ``grain`` ids. The
histogram of classes (at most capacity / grain numbers, however large the
table) goes to the driver, where column generation solves the linear program
over patterns: a knapsack dynamic program prices new patterns from the dual
values until Farley's bound is within ``gap``. Rounded-down patterns and
first-fit-decreasing patterns for what is left give each class its slots.
Pieces are ranked within their class by two-level counts (task, then task
offsets), and rank r takes slot r.

Null texts are empty: they have the end id alone. Repeated rows are packed
each. Other columns are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import scratch, tokens

PIECE = "chunk long, no long, doc_id {id}, start long, length long, doc_tokens long, class int, rank long, ids binary"


def cut(docs: DataFrame, end_id: int, capacity: int, grain: int, tokenizer: str) -> DataFrame:
    """Pieces with their ids; chunk and no name a piece, class counts grains
    (0: full), rank counts the pieces of a class within its chunk."""

    def pieces(batches):
        chunk, no, seen = uuid.uuid4().int >> 65, 0, np.zeros(capacity // grain + 1, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, flat, off in tokens.encoder(tokenizer).encode(batch.column("text")):
                # insert the end id behind each document
                flat = np.insert(flat, off[1:], end_id).astype("<u4")
                off = off + np.arange(len(off))
                n = np.diff(off)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(n[doc] - start, capacity)
                kind = np.where(length == capacity, 0, -(-length // grain))
                order = np.argsort(kind, kind="stable")
                sizes = np.bincount(kind, minlength=len(seen))
                rank = np.empty(len(kind), np.int64)
                rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(seen, sizes)
                seen += sizes
                at = (off[doc] + start).astype(np.int64)
                cuts = np.concatenate((at, [len(flat)])).astype(np.int32) * 4
                blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), chunk)), pa.array(np.arange(no, no + len(doc))), ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(kind.astype(np.int32)), pa.array(rank), blob],
                    ["chunk", "no", "doc_id", "start", "length", "doc_tokens", "class", "rank", "ids"],
                )
                no += len(doc)

    return docs.mapInArrow(pieces, PIECE.format(id=docs.schema["doc_id"].dataType.simpleString()))


def best_pattern(size: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size)
    size_up, value_up = size[order], value[order]
    for c in range(1, capacity + 1):
        k = np.searchsorted(size_up, c, "right")
        best[c] = best[c - 1]
        if k:
            total = best[c - size_up[:k]] + value_up[:k]
            i = int(total.argmax())
            if total[i] > best[c] + 1e-12:
                best[c], took[c] = total[i], order[i]
    pattern, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= size[took[c]]
    return float(best[capacity]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination with pivoting; no BLAS threads, which can hang in a forked driver."""
    m = len(a)
    both = np.hstack((a, np.eye(m)))
    for k in range(m):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k][None, :]
    return both[:, m:]


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns over the classes and how often to use each; all demand is met exactly."""
    m = len(size)
    used: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    if m:
        columns = [np.eye(m, dtype=np.int64)[i] * (capacity // size[i]) for i in range(m)]
        inverse = np.diag([1.0 / c.max() for c in columns])
        x = inverse @ left
        for step in range(20 * m):  # any basis is a valid plan
            dual = inverse.sum(axis=0)
            value, pattern = best_pattern(size, np.maximum(dual, 0), capacity)
            if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= gap * x.sum():
                break
            turn = inverse @ pattern
            ratio = np.where(turn > 1e-9, x / np.where(turn > 1e-9, turn, 1), np.inf)
            out = int(ratio.argmin())
            columns[out] = pattern
            if step % 100 == 99:
                inverse = inverted(np.array(columns, float).T)
            else:
                row = inverse[out] / turn[out]
                inverse -= np.outer(turn, row)
                inverse[out] = row
            x = np.maximum(inverse @ left, 0)
        for c, often in sorted(zip(columns, np.floor(x + 1e-9).astype(np.int64)), key=lambda p: -p[1]):
            often = int(min(often, *(left[c > 0] // c[c > 0])))
            if often > 0:
                used.append((c, often))
                left = left - c * often
    # what rounding left, largest class first, into the first pattern with room
    rest: list[tuple[np.ndarray, int]] = []
    room = np.zeros(0, np.int64)
    for i in np.argsort(-size, kind="stable"):
        for _ in range(int(left[i])):
            fits = np.flatnonzero(room >= size[i])
            if not len(fits):
                rest.append((np.zeros(m, np.int64), 1))
                room, fits = np.append(room, capacity), [len(room)]
            rest[fits[0]][0][i] += 1
            room[fits[0]] -= size[i]
    return used + rest


def slots(size: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, pieces a sequence, first sequence, place in the pattern) for
    each class of each pattern; bounded by the number of classes."""
    taken, first, out = np.zeros(len(size), np.int64), 0, []
    for pattern, often in patterns:
        for place, i in enumerate(np.flatnonzero(pattern)):
            out.append((int(size[i]), int(taken[i]), int(pattern[i]), first, place))
        taken += pattern * often
        first += often
    return out


def place(pieces: DataFrame, capacity: int, grain: int) -> DataFrame:
    """(chunk, no, sequence_id, offset) for staged pieces."""
    spark = pieces.sparkSession
    pieces = pieces.select("chunk", "no", "class", "rank", "length")
    counts = pieces.groupBy("chunk", "class").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = scratch.staged(counts.withColumn("before", F.coalesce(before, F.lit(0))), "counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    size = np.array(sorted(k for k in histogram if k), np.int64)
    patterns = solve(size, np.array([histogram[k] for k in size], np.int64), capacity // grain)
    table = slots(size, patterns)
    full = sum(often for _, often in patterns)
    by_class: dict[int, tuple[np.ndarray, ...]] = {k: tuple(np.array([t[j] for t in table if t[0] == k], np.int64) for j in range(1, 5)) for k in size.tolist()}

    def assign(batches):
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, at = full + rank, np.zeros(len(rank), np.int64)
            for k in np.unique(kind[kind > 0]).tolist():
                mine = np.flatnonzero(kind == k)
                first, each, base, spot = by_class[k]
                j = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = base[j] + (rank[mine] - first[j]) // each[j]
                at[mine] = (spot[j] << 32) + rank[mine] - first[j]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("no"), batch.column("length"), pa.array(sequence), pa.array(at)], ["chunk", "no", "length", "sequence_id", "at"])

    ranked = pieces.join(counts.select("chunk", "class", "before"), ["chunk", "class"]).select("chunk", "no", "class", "length", (F.col("before") + F.col("rank")).alias("rank"))
    ahead = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(assign, "chunk long, no long, length long, sequence_id long, at long").select("chunk", "no", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, grain: int = 16, tokenizer: str | None = None, payload: Column | None = None) -> DataFrame:
    """One row per piece: the id, start, length, doc_tokens, sequence_id,
    offset, and payload, an expression over the piece's ``ids`` (its
    little-endian unsigned 32-bit ids; by default the ids themselves)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.staged(cut(rows, end_id, capacity, grain, tokenizer or tokens.default_path()), "pieces")
    own = pieces.select("chunk", "no", "doc_id", "start", "length", "doc_tokens", (F.col("ids") if payload is None else payload).alias("payload"))
    return own.join(place(pieces, capacity, grain), ["chunk", "no"]).drop("chunk", "no").withColumnRenamed("doc_id", id_col)
