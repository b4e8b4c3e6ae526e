"""Token-id files in Simple-8b: 64-bit words whose upper four bits select how
many ids of how many bits the other sixty hold.

File: magic, blocks, footer, trailer. A block is two little-endian 32-bit
counts (ids, words) and its words. The footer holds the blocks' offsets and, as
an Arrow stream, for each document its id, of any type, and number of ids, so
that any document is found without reading what lies before it. The trailer
gives the footer's length.

Documents are dealt by ranges of their id and of a hash, so that equal or null
ids can fill several files, and written in ascending order of id (nulls first,
ties by the hash). A file's name is unique to the attempt that wrote it and
counts only once it is in the manifest, so lost executors and repeated tasks
leave no wrong files. Null texts are empty: they have the end id alone. Very
long texts span blocks; one must fit into a task's memory. Repeated rows are
written each. Other columns are not carried and may have any name; an empty
table gives an empty manifest.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm import scratch, tokens

MAGIC = b"PLTOKS8B"
BLOCK = 1 << 16  # ids
# selector: (ids, bits of each); selector 1 escapes: the next word is one id of up to 64 bits
SELECTORS = [(240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


def encode(ids: np.ndarray) -> np.ndarray:
    """Words for the ids, each word taking as many of the next ids as fit."""
    v, n = ids.astype(np.uint64), len(ids)
    best = np.ones(n, np.uint8)  # the selector at each position: 1 where nothing else fits
    need = np.zeros(n + 240, np.uint8)  # bits of each id; nothing behind the last one needs any
    need[:n] = np.frexp(v.astype(np.float64))[1] if n and v.max() < 1 << 53 else np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), v, "right")
    most, count = need, 1  # bits of the widest of each run of count ids
    for s in range(len(SELECTORS) - 1, -1, -1):
        if s == 1:
            continue
        want, bits = SELECTORS[s]
        while count < want:
            more = min(want - count, count)
            most = np.maximum(most[: len(most) - more], most[more:])
            count += more
        np.putmask(best, most[:n] <= bits, s)
    step = np.array([c for c, _ in SELECTORS])[best].tolist()
    starts, p = [], 0
    while p < n:
        starts.append(p)
        p += step[p]
    start = np.array(starts, np.int64)
    chosen = best[start]
    word_at = np.concatenate(([0], np.cumsum(1 + (chosen == 1))))
    out = np.zeros(word_at[-1], np.uint64)
    padded = np.concatenate((v, np.zeros(240, np.uint64)))
    for s, (count, bits) in enumerate(SELECTORS):
        k = np.flatnonzero(chosen == s)
        if not len(k):
            continue
        out[word_at[k]] = np.uint64(s) << np.uint64(60)
        if s == 1:
            out[word_at[k] + 1] = v[start[k]]
        elif bits:
            many = padded[start[k][:, None] + np.arange(count)[None, :]]
            out[word_at[k]] |= np.bitwise_or.reduce(many << (np.arange(count, dtype=np.uint64) * np.uint64(bits))[None, :], axis=1)
    return out


def decode(words: np.ndarray, n: int) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(chosen == 1):
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    size = np.array([c for c, _ in SELECTORS])[chosen]
    size[raw] = 0
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        k = np.flatnonzero((chosen == s) & ~raw)
        if not len(k):
            continue
        if s == 1:
            out[at[k]] = words[k + 1]
        elif bits:
            shift = (np.arange(count, dtype=np.uint64) * np.uint64(bits))[None, :]
            out[at[k][:, None] + np.arange(count)[None, :]] = (words[k][:, None] >> shift) & np.uint64((1 << bits) - 1)
    return out[:n]


class Writer:
    """One file, written as ids come; holds less than a block."""

    def __init__(self, out):
        self.out, self.size, self.blocks, self.docs, self.rest = out, 0, [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc_id: pa.Scalar, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        if sum(map(len, self.rest)) >= BLOCK:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ids[i : i + BLOCK])
            self.rest = [ids[whole:]]

    def _block(self, ids: np.ndarray) -> None:
        words = encode(ids)
        self.blocks.append(self.size)
        self._put(np.array([len(ids), len(words)], "<u4").tobytes() + words.astype("<u8").tobytes())

    def close(self) -> tuple[int, int, int]:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        if len(ids):
            self._block(ids)
        names = pa.array([d for d, _ in self.docs], self.docs[0][0].type)
        table = pa.table({"id": names, "n": pa.array([n for _, n in self.docs], pa.int64())})
        listed = pa.BufferOutputStream()
        with pa.ipc.new_stream(listed, table.schema) as stream:
            stream.write_table(table)
        foot = np.array([len(self.blocks)], "<i8").tobytes() + np.array(self.blocks, "<i8").tobytes() + listed.getvalue().to_pybytes()
        self._put(foot + np.array([len(foot)], "<i8").tobytes() + MAGIC)
        self.out.close()
        return len(self.docs), sum(n for _, n in self.docs), self.size


class Reader:
    """Documents of a file in order; holds a block and the document at hand."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(tail[:8], "<i8")[0])
        foot = file.read_at(n, size - 16 - n)
        blocks = int(np.frombuffer(foot[:8], "<i8")[0])
        self.blocks = np.frombuffer(foot, "<i8", blocks, 8)
        self.docs = pa.ipc.open_stream(foot[8 + 8 * blocks :]).read_all().combine_chunks()

    def _block(self, k: int) -> np.ndarray:
        n, words = np.frombuffer(self.file.read_at(8, int(self.blocks[k])), "<u4")
        return decode(np.frombuffer(self.file.read_at(int(words) * 8, int(self.blocks[k]) + 8), "<u8"), int(n))

    def __iter__(self):
        k, have = 0, np.zeros(0, np.uint64)
        for doc, n in zip(self.docs["id"], self.docs["n"].to_pylist()):
            parts, left = [], n
            while left:
                if not len(have):
                    have, k = self._block(k), k + 1
                parts.append(have[:left])
                have = have[left:]
                left -= len(parts[-1])
            yield doc, np.concatenate(parts) if parts else have[:0]


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Writes the files and returns their manifest (part, file, n_docs, n_ids,
    n_bytes, start), start being the number of ids in all files before."""
    spark = docs.sparkSession
    path = tokenizer or tokens.default_path()
    folder = scratch.new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    parts = scratch.buckets_for(spark, scratch.text_bytes(rows), 64 << 20)

    def save(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        writer, name = None, f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.s8b"
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, flat, off in tokens.encoder(path).encode(batch.column("text")):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = Writer(fs.open_output_stream(name))
                for i in range(lo, hi):
                    writer.add(ids[i], np.append(flat[off[i - lo] : off[i - lo + 1]], np.uint32(end_id)))
        if writer is not None:
            n_docs, n_ids, n_bytes = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": name, "n_docs": n_docs, "n_ids": n_ids, "n_bytes": n_bytes}])

    made = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").mapInArrow(save, "part long, file string, n_docs long, n_ids long, n_bytes long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = scratch.staged(made, "manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # the ids' type goes with the manifest as a column that has no values
    return manifest.withColumn("id", F.lit(None).cast(docs.schema[id_col].dataType))


def read(manifest: DataFrame, folder_of: str | None = None) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the manifest's files;
    ids as little-endian unsigned 32-bit integers."""
    root = scratch.shared_dir(manifest.sparkSession)
    kind = manifest.schema["id"].dataType

    def load(batches):
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for doc, ids in Reader(file):
                        rows.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                        start, held = start + len(ids), held + 4 * len(ids)
                        if held > 8 << 20:
                            yield as_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (to_arrow_type(kind), pa.int64(), pa.int64(), pa.binary()))], ["id", "start", "n_tokens", "ids"])

    # one task a file: the manifest is as short as the list of files
    files = manifest.select("file", "start").repartition(scratch.buckets_for(manifest.sparkSession, 0))
    return files.mapInArrow(load, f"id {kind.simpleString()}, start long, n_tokens long, ids binary")
