"""Exact substring deduplication by fixed-block anchors.

Every document's non-overlapping blocks of ``block`` words are indexed and
probed with every rolling window of ``block`` words of the corpus. With
``block = (window + 1) // 2`` each window of ``window`` words holds one whole
block of its own document, so a window that occurs twice holds a block that a
rolling window elsewhere hits. The surroundings of hit blocks are then extended
word by word: all windows over a hit block are compared by two 64-bit hashes,
and the union of those that occur twice are the maximal exact repeats.

Windows are dealt by the smallest rolling block hash inside them, which
neighbours share, so a repeat travels as a few runs and comes back as ranges.
Skew: a text that occurs more than once is whole a repeat and stands in the
comparison once; hashes are counted before they are shuffled; smallest hashes
that lead more runs than 2**-22 of the bytes under study, and windows that
occur as often, are broadcast (2**21 each by that bound, as a window has two
bytes at least): the former deal their windows by the windows' own hashes, the
latter are repeats. Texts with as many copies are looked up in a broadcast too.

Null and empty texts have no words, and texts of fewer than ``window`` words no
window. Very long texts are cut into windows like all others; one text must fit
into a task's memory. Repeated rows count as separate places, ties don't arise.
Rows keep their id; other columns are not carried and may have any name. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import scratch, spans
from plumbline.llm.spans import U64

KEY = 5  # bytes of an anchor's hash that are exchanged, besides its bucket
ALL = (1 << 31) - 1  # a range's end beyond any text
FEW = 1000  # what is no more frequent than this is never broadcast


def _anchors(h: np.ndarray, w: spans.Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all rolling windows of ``block`` words, where they start, and which are aligned."""
    s = w.window_starts(block)
    return spans.window_hash(h, block)[s], s, (s - w.first[w.doc[s]]) % block == 0


def _anchor_key(h: np.ndarray, n: int) -> np.ndarray:
    return (spans.bucket_of(h, n) << 40) | (h & U64((1 << 40) - 1)).astype(np.int64)


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


def _column(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table[name]]


def repeated_anchors(docs: DataFrame, block: int, n: int) -> DataFrame:
    """Keys of aligned blocks that at least two rolling windows match."""

    def emit(batches):
        for batch in batches:
            rolled, aligned = [np.zeros(0, U64)], [np.zeros(0, U64)]
            for w in spans.words(batch.column("text")):
                h, _, own = _anchors(w.hashes(), w, block)
                rolled.append(h)
                aligned.append(h[own])
            u, c = np.unique(np.concatenate(rolled), return_counts=True)
            a = np.unique(np.concatenate(aligned))
            ab = spans.bucket_of(a, n)
            rows = []
            for b, at in spans.by_bucket(spans.bucket_of(u, n)):
                lo, hi = np.searchsorted(ab, [b, b + 1])
                rows.append((b, spans.pack(a[lo:hi], KEY), spans.pack(u[at], KEY), np.packbits(c[at] > 1).tobytes()))
            if rows:
                yield _rows(["bucket", "aligned", "rolled", "many"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()], rows)

    def meet(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        own = np.unique(np.concatenate([spans.unpack(x.as_buffer().to_pybytes(), KEY) for x in t["aligned"]]))
        count = np.zeros(len(own), np.int64)
        for rolled, many in zip(t["rolled"], t["many"]):
            k = spans.unpack(rolled.as_buffer().to_pybytes(), KEY)
            if len(own):
                at = np.minimum(np.searchsorted(own, k), len(own) - 1)
                hit = own[at] == k
                more = np.unpackbits(np.frombuffer(many.as_buffer().to_pybytes(), np.uint8), count=len(k))
                np.add.at(count, at[hit], 1 + more[hit].astype(np.int64))
        key = (np.int64(t["bucket"][0].as_py()) << 40) | own[count > 1].astype(np.int64)
        return pa.table({"anchor": pa.array(key, pa.int64())})

    rows = docs.select("text").mapInArrow(emit, "bucket long, aligned binary, rolled binary, many binary")
    return rows.repartition(n, "bucket").groupBy("bucket").applyInArrow(meet, "anchor long")


def own_anchors(docs: DataFrame, block: int, n: int) -> DataFrame:
    """One row per aligned block of each text, once for equal texts of a batch."""

    def emit(batches):
        for batch in batches:
            key = batch.column("key")
            first = np.zeros(batch.num_rows, bool)
            first[list({k: i for i, k in enumerate(key.to_pylist())}.values())] = True
            for w in spans.words(batch.column("text")):
                h, s, own = _anchors(w.hashes(), w, block)
                own &= first[w.lo + w.doc[s]]
                s, doc = s[own], w.doc[s[own]]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(w.lo + doc)), pa.array((s - w.first[doc]).astype(np.int32)), pa.array(_anchor_key(h[own], n))], ["key", "at", "anchor"])

    return docs.select("key", "text").mapInArrow(emit, "key binary, at int, anchor long")


def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values."""
    size = 1
    while size < n:
        more = min(size, n - size)
        v, size = np.minimum(v[:-more], v[more:]), size + more
    return v


class Candidates:
    """Of one piece of a batch: the windows over hit blocks, where they start,
    the smallest block hash and the two hashes of each."""

    def __init__(self, w: spans.Words, at: np.ndarray, doc: np.ndarray, block: int, window: int):
        s = (w.first[doc] + at)[:, None] + np.arange(block - window, 1)[None, :]
        s = np.unique(s[(s >= w.first[doc][:, None]) & (s + window <= w.first[doc + 1][:, None])])
        self.w, self.s, self.pos = w, s, s - w.first[w.doc[s]] if len(s) else s
        if len(s):
            h = w.hashes()
            self.low = sliding_min(spans.window_hash(h, block), window - block + 1)[s]
            self.k1, self.k2 = spans.window_hash(h, window)[s], spans.window_hash(w.hashes(1), window, 1)[s]
        else:
            self.low = self.k1 = self.k2 = np.zeros(0, U64)

    def runs(self) -> np.ndarray:
        """Where runs of neighbouring windows with one smallest block hash begin."""
        s = self.s
        return np.flatnonzero(np.r_[True, (np.diff(s) != 1) | (self.low[1:] != self.low[:-1])]) if len(s) else s


def _candidates(batch: pa.RecordBatch, block: int, window: int):
    at = batch.column("at")
    flat, off = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    for w in spans.words(batch.column("text")):
        doc = np.repeat(np.arange(w.hi - w.lo), np.diff(off[w.lo : w.hi + 1]))
        yield Candidates(w, flat[off[w.lo] : off[w.hi]], doc, block, window)


def _sorted_runs(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (k1, k2), and where runs of equal pairs begin in it."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, np.int64)


def _is_in(k1: np.ndarray, k2: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """known: pairs sorted by their first part, which occurs once in it."""
    if not len(known[0]) or not len(k1):
        return np.zeros(len(k1), bool)
    at = np.minimum(np.searchsorted(known[0], k1), len(known[0]) - 1)
    return (known[0][at] == k1) & (known[1][at] == k2)


def _frequent(hits: DataFrame, keys_of, n: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of hashes that keys_of finds more than ``above`` times in all
    pieces; counted from one entry for each pair and batch."""

    def emit(batches):
        for batch in batches:
            k1, k2 = (np.concatenate(x) for x in zip((np.zeros(0, U64),) * 2, *keys_of(batch)))
            order, run = _sorted_runs(k1, k2)
            c = np.diff(np.r_[run, len(order)])
            k1, k2 = k1[order][run], k2[order][run]
            rows = [(b, k1[x].tobytes(), k2[x].tobytes(), c[x].astype("<u4").tobytes()) for b, x in spans.by_bucket(spans.bucket_of(k1, n))]
            if rows:
                yield _rows(["bucket", "k1", "k2", "c"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()], rows)

    def add(table: pa.Table) -> pa.Table:
        k1, k2, c = (np.concatenate(_column(table, k, t)) for k, t in (("k1", "<u8"), ("k2", "<u8"), ("c", "<u4")))
        order, run = _sorted_runs(k1, k2)
        total = np.add.reduceat(c[order].astype(np.int64), run)
        k1, k2 = k1[order][run][total > above], k2[order][run][total > above]
        return pa.table({"k1": k1.view(np.int64), "k2": k2.view(np.int64)})

    rows = hits.mapInArrow(emit, "bucket long, k1 binary, k2 binary, c binary")
    found = rows.repartition(n, "bucket").groupBy("bucket").applyInArrow(add, "k1 long, k2 long").collect()
    found = np.array([tuple(r) for r in found], np.int64).reshape(-1, 2).view(U64)
    found = found[np.argsort(found[:, 0], kind="stable")]
    return found[:, 0].copy(), found[:, 1].copy()


def crowded(hits: DataFrame, block: int, window: int, n: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest block hashes that lead more than ``above`` runs."""

    def keys_of(batch):
        for c in _candidates(batch, block, window):
            low = c.low[c.runs()]
            yield low, low

    return _frequent(hits, keys_of, n, above)


def heavy(hits: DataFrame, block: int, window: int, n: int, above: int, crowds) -> tuple[np.ndarray, np.ndarray]:
    """Windows led by crowded hashes that occur more than ``above`` times themselves."""

    def keys_of(batch):
        for c in _candidates(batch, block, window):
            of = _is_in(c.low, c.low, crowds.value)
            yield c.k1[of], c.k2[of]

    return _frequent(hits, keys_of, n, above)


def heavy_ranges(hits: DataFrame, block: int, window: int, known) -> DataFrame:
    """Ranges of starts of heavy windows, by text."""

    def run(batches):
        for batch in batches:
            for c in _candidates(batch, block, window):
                of = np.flatnonzero(_is_in(c.k1, c.k2, known.value))
                if len(of):
                    first, end = _ranges(c.w.doc[c.s[of]], c.pos[of])
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(c.w.lo + c.w.doc[c.s[of[first]]])), pa.array((c.pos[of[first]] << 32) | (c.pos[of[end]] + 1))], ["key", "range"])

    return hits.select("key", "text", "at").mapInArrow(run, "key binary, range long")


def _ranges(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive places of one document."""
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(pos) != 1))
    return np.r_[0, cut + 1], np.r_[cut, len(doc) - 1]


def repeated_windows(hits: DataFrame, block: int, window: int, n: int, crowds, known) -> DataFrame:
    """Ranges of starts of repeated windows that are not heavy, by text; texts
    that occur more than once take part but get no ranges."""

    def emit(batches):
        for batch in batches:
            key, single = np.array(batch.column("key").to_pylist(), object), batch.column("copies").to_numpy() == 1
            parts = []
            for c in _candidates(batch, block, window):
                if not len(c.s):
                    continue
                alone = _is_in(c.low, c.low, crowds.value)  # windows that are dealt by their own hashes
                loud = _is_in(c.k1, c.k2, known.value)
                begin = np.zeros(len(c.s), bool)
                begin[c.runs()] = True
                begin[1:] |= loud[:-1]
                begin |= alone | loud
                run = np.cumsum(begin) - 1
                keep = ~loud
                parts.append((np.where(alone, c.k1, c.low)[keep], c.k1[keep], c.k2[keep], (c.w.lo + c.w.doc[c.s])[keep], c.pos[keep], run[keep]))
            if not parts:
                continue
            base = np.cumsum([0, *(int(p[5][-1]) + 1 if len(p[5]) else 0 for p in parts)])
            deal, k1, k2, doc, pos, run = (np.concatenate([p[i] if i < 5 else p[i] + b for p, b in zip(parts, base)]) for i in range(6))
            bucket = spans.bucket_of(spans.mix(deal, 9), n)
            order = np.argsort(bucket, kind="stable")
            deal, k1, k2, doc, pos, run, bucket = (x[order] for x in (deal, k1, k2, doc, pos, run, bucket))
            rows = []
            for b, x in spans.by_bucket(bucket):
                first = np.flatnonzero(np.r_[True, np.diff(run[x]) != 0])
                size = np.diff(np.r_[first, x.stop - x.start])
                own, local = np.unique(doc[x][first], return_inverse=True)
                ids = b"".join(key[own].tolist())
                rows.append((b, k1[x].tobytes(), k2[x].astype("<u4").tobytes(), local.astype("<u4").tobytes(), pos[x][first].astype("<u4").tobytes(), size.astype("<u4").tobytes(), ids, single[own].astype(np.uint8).tobytes()))
            yield _rows(NAMES, [pa.int64()] + [pa.binary()] * 7, rows)

    def meet(table: pa.Table) -> pa.Table:
        kinds = dict(zip(NAMES[1:], ("<u8", "<u4", "<u4", "<u4", "<u4", "V16", "<u1")))
        part = {k: _column(table, k, t) for k, t in kinds.items()}
        base = np.concatenate(([0], np.cumsum([len(x) for x in part["single"]])))
        part["doc"] = [d + b for d, b in zip(part["doc"], base)]
        k1, k2, doc, pos, size, key, single = (np.concatenate(part[k]) for k in NAMES[1:])
        doc, ahead = np.repeat(doc, size), np.cumsum(size, dtype=np.int64) - size
        pos = np.repeat(pos.astype(np.int64), size) + np.arange(len(k1)) - np.repeat(ahead, size)
        order, run = _sorted_runs(k1, k2)
        often = np.diff(np.r_[run, len(order)])
        found = order[np.repeat(often > 1, often)]
        found = found[single[doc[found]] == 1]
        found = found[np.lexsort((pos[found], doc[found]))]
        first, end = _ranges(doc[found], pos[found]) if len(found) else (found, found)
        names = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.arange(len(first) + 1, dtype=np.int32) * 16), pa.py_buffer(key[doc[found[first]]].tobytes())])
        return pa.table([names, pa.array((pos[found[first]] << 32) | (pos[found[end]] + 1), pa.int64())], names=["key", "range"])

    rows = hits.mapInArrow(emit, f"bucket long, {', '.join(f'{x} binary' for x in NAMES[1:])}")
    return rows.repartition(n, "bucket").groupBy("bucket").applyInArrow(meet, "key binary, range long")


NAMES = ["bucket", "k1", "k2", "doc", "pos", "size", "key", "single"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(id, n_words, n_removed, text): the words of each document that no
    repeated window covers, joined by single spaces."""
    spark = docs.sparkSession
    block = (window + 1) // 2
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    size = scratch.text_bytes(whole)
    n = scratch.buckets_for(spark, size)
    anchors = repeated_anchors(whole, block, n)
    at = own_anchors(whole, block, n).join(anchors, "anchor", "left_semi").groupBy("key").agg(F.collect_set("at").alias("at"))
    distinct = whole.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    hits = scratch.staged(distinct.join(at, "key").select("key", "text", "copies", "at"), "hits")
    above = max(FEW, scratch.text_bytes(hits) >> 22)
    crowds = crowded(hits, block, window, n, above)
    known = (np.zeros(0, U64),) * 2
    shared = spark.sparkContext.broadcast(crowds)
    if len(crowds[0]):
        known = heavy(hits, block, window, n, above, shared)
    known_shared = spark.sparkContext.broadcast(known)
    ranges = repeated_windows(hits, block, window, n, shared, known_shared)
    if len(known[0]):
        ranges = ranges.unionByName(heavy_ranges(hits.where("copies = 1"), block, window, known_shared))
    copied = hits.where("copies > 1")
    ranges = ranges.unionByName(copied.select("key", F.lit(ALL).cast("long").alias("range")))
    ranges = scratch.staged(ranges.groupBy("key").agg(F.collect_list("range").alias("ranges")), "ranges")
    # no task gets all rows of a text with very many copies
    loud = [r["key"] for r in copied.where(F.col("copies") > max(FEW, size >> 22)).select("key").collect()]
    scratch.discard(hits)

    def cut(batches):
        for batch in batches:
            of, kept, n_words, n_removed = batch.column("ranges"), [], [], []
            off = np.concatenate(([0], np.cumsum(of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            flat = of.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for w in spans.words(batch.column("text")):
                doc = np.repeat(np.arange(w.hi - w.lo), np.diff(off[w.lo : w.hi + 1]))
                r = flat[off[w.lo] : off[w.hi]]
                size = np.diff(w.first)
                lo, hi = r >> 32, np.minimum(r & 0xFFFFFFFF, size[doc] - window + 1)
                doc, lo, hi = doc[lo < hi], lo[lo < hi], hi[lo < hi]
                delta = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(delta, w.first[doc] + lo, 1)
                np.add.at(delta, w.first[doc] + hi + window - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                for i in range(w.hi - w.lo):
                    of_text = w.raw[w.doc_start[i] : w.doc_start[i + 1]].tobytes().split()
                    mask = gone[w.first[i] : w.first[i + 1]]
                    n_words.append(len(of_text))
                    n_removed.append(int(mask.sum()))
                    kept.append(b" ".join(of_text if not n_removed[-1] else [x for x, y in zip(of_text, mask) if not y]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "text"])

    rest = whole
    if loud:
        known_loud = F.broadcast(spark.createDataFrame([(bytes(k),) for k in loud], "key binary"))
        rest = whole.join(known_loud, "key", "left_anti")
    out = rest.join(ranges, "key", "left").select("id", "text", "ranges")
    if loud:
        out = out.unionByName(whole.join(known_loud, "key", "left_semi").select("id", "text", F.array(F.lit(ALL).cast("long")).alias("ranges")))
    return out.mapInArrow(cut, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, text string").withColumnRenamed("id", id_col)
