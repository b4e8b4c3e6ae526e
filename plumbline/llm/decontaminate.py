"""Benchmark decontamination by SimHash over item-sized windows.

A window has as many words as the item it is compared with (lower-case A-Z).
Windows of which less than ``similarity`` of the shingles of five words occur
in any item at all can't be similar and are passed over; of all others, for
each length an item has, the 128-bit SimHash of their words is taken from
running sums of bits. A multi-index of the items' fingerprints finds every item
within ``radius`` bits: of eight blocks of 16 bits one must differ in
radius // 8 bits at most, and each item stands in each block's table under all
values so near. At a radius of 23 that proposes 1.7 % of unlike pairs.
Candidates are verified by the exact similarity of weighted shingles: of both
multisets, which are of one size, the share that they have in common. A
document shorter than an item is one window as a whole; its share is that of
the item's shingles.

Items are taken in blocks of bounded size; each block's index is broadcast, sees
all documents, and is given up before the next one. Items of fewer than five
words are compared by their whole word sequence; null and empty items match
nothing. Null and empty texts have no words. Very long texts are worked through
in stretches. Of windows with a tie in similarity the first is given. Repeated
rows are judged each, repeated items match each. Ids of any type and other
columns of any name are kept; empty tables give no matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from plumbline.llm import scratch, spans
from plumbline.llm.spans import U64

SHINGLE, RADIUS, SIMILARITY = 5, 23, 0.8
ITEMS, BYTES = 8_000, 16 << 20  # most items and bytes of their texts in a block
TABLE = 22  # bits of the screen
BITS = np.arange(64, dtype=U64)
BLOCKS, WIDTH = 8, 16  # of a fingerprint: blocks, and bits of each
STRETCH = 1 << 16  # words whose bits are summed at once


def shingle_hashes(h: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    return spans.window_hash(h, k)[start]


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Running sums of +1 or -1 for each bit of each word's hash."""
    out = np.zeros((len(h) + 1, BLOCKS * WIDTH), np.int32)
    for half in (0, 1):
        bits = ((spans.mix(h, 7 + half)[:, None] >> BITS[None, :]) & U64(1)).astype(np.int32)
        np.cumsum(2 * bits - 1, axis=0, out=out[1:, 64 * half : 64 * half + 64])
    return out


def fingerprints(sums: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """One row a window: the values of its blocks."""
    on = (sums[start + n] - sums[start]) > 0
    return np.packbits(on, axis=1, bitorder="little").view("<u2")


def fingerprint(h: np.ndarray) -> np.ndarray:
    """That of all words, as one row."""
    total = sum(bit_sums(h[lo : lo + STRETCH])[-1].astype(np.int64) for lo in range(0, len(h), STRETCH))
    return np.packbits(total > 0, bitorder="little").view("<u2")[None, :]


def near_values(far: int) -> np.ndarray:
    """What a block's value is combined with to give all values at most far bits away."""
    return np.array([sum(1 << b for b in some) for k in range(far + 1) for some in combinations(range(WIDTH), k)], np.uint16)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two multisets."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[i], cb[j]).sum())


@dataclass
class Index:
    """Items of one block: what is looked up for windows of documents."""

    ids: pa.Array
    length: np.ndarray
    shingles: list[np.ndarray]
    prints: np.ndarray  # one row an item
    screen: np.ndarray  # bits of shingle hashes
    known: dict[int, np.ndarray]  # by shingle width: sorted hashes
    radius: int
    similarity: float

    @classmethod
    def build(cls, ids: pa.Array, texts: pa.Array, radius: int, similarity: float) -> Index:
        own, length, shingles, prints = [], [], [], [np.zeros((0, BLOCKS), np.uint16)]
        for w in spans.words(texts, lower=True):
            h = w.hashes()
            for i in range(w.hi - w.lo):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if b == a:
                    continue
                k = min(SHINGLE, b - a)
                own.append(w.lo + i)
                length.append(b - a)
                shingles.append(shingle_hashes(h, np.arange(a, b - k + 1), k))
                prints.append(fingerprint(h[a:b]))
        known = {}
        for k in sorted({min(SHINGLE, n) for n in length}):
            known[k] = np.unique(np.concatenate([s for s, n in zip(shingles, length) if min(SHINGLE, n) == k]))
        screen = np.zeros(1 << TABLE, bool)
        for hashes in known.values():
            screen[(hashes >> U64(64 - TABLE)).astype(np.int64)] = True
        return cls(ids.take(pa.array(own, pa.int64())), np.array(length, np.int64), shingles, np.concatenate(prints), screen, known, radius, similarity)

    def tables(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block, the sorted values near those of the items of length n, and these items."""
        if not hasattr(self, "cache"):
            self.cache = {}
        if n not in self.cache:
            of, out = np.flatnonzero(self.length == n), []
            near = near_values(self.radius // BLOCKS)
            for k in range(BLOCKS):
                v = (self.prints[of, k][:, None] ^ near[None, :]).reshape(-1)
                order = np.argsort(v, kind="stable")
                out.append((v[order], np.repeat(of, len(near))[order]))
            self.cache[n] = out
        return self.cache[n]

    def proposed(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All (print, item of length n) that agree nearly in a block."""
        found = []
        for k, (values, items) in enumerate(self.tables(n)):
            lo, hi = np.searchsorted(values, prints[:, k], "left"), np.searchsorted(values, prints[:, k], "right")
            count = hi - lo
            which = np.repeat(np.arange(len(prints)), count)
            item = items[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(which))]
            found.append(which * len(self.ids) + item)
        pair = np.unique(np.concatenate(found))
        return pair // len(self.ids), pair % len(self.ids)

    def near(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All (print, item of length n) within the radius."""
        which, item = self.proposed(prints, n)
        ok = np.bitwise_count(prints[which] ^ self.prints[item]).sum(axis=1, dtype=np.int64) <= self.radius
        return which[ok], item[ok]

    def matches(self, texts: pa.Array):
        """(text, item, first word, similarity) of each similar pair, at the best window."""
        for w in spans.words(texts, lower=True):
            h = w.hashes()
            hits = {}
            for k, known in self.known.items():
                s = w.window_starts(k)
                v = shingle_hashes(h, s, k)
                maybe = np.flatnonzero(self.screen[(v >> U64(64 - TABLE)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, v[maybe]), len(known) - 1)
                hits[k] = s[maybe[known[at] == v[maybe]]]
            yield from ((w.lo + int(w.doc[at]), i, int(at - w.first[w.doc[at]]), share) for i, at, share in self.best(w, h, hits))

    def best(self, w: spans.Words, h: np.ndarray, hits: dict[int, np.ndarray]):
        """(item, first word, similarity) of the best window of each document and item."""
        windows = {n: self.candidates(w, n, hits[min(SHINGLE, n)]) for n in np.unique(self.length).tolist()} if hits else {}
        windows = {n: s for n, s in windows.items() if len(s)}
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for n in np.unique(self.length).tolist() if hits else ():
            self.shorter(w, h, n, hits[min(SHINGLE, n)], found)
        if not windows:
            return [(i, at, share) for (_, i), (share, at) in sorted(found.items())]
        prints: dict[int, list[np.ndarray]] = {}
        for a, b, end in stretches(np.unique(np.concatenate(list(windows.values()))), max(windows)):
            sums = bit_sums(h[a : min(end, len(h))])
            for n, s in windows.items():
                own = s[np.searchsorted(s, a) : np.searchsorted(s, b)]
                if len(own):
                    prints.setdefault(n, []).append(fingerprints(sums, own - a, n))
        for n, s in windows.items():
            which, item = self.near(np.concatenate(prints.pop(n)), n)
            k = min(SHINGLE, n)
            for at, i in zip(s[which].tolist(), item.tolist()):
                shingles = shingle_hashes(h[at : at + n], np.arange(n - k + 1), k)
                share = common(shingles, self.shingles[i]) / len(shingles)  # both have as many
                key = (int(w.doc[at]), i)
                if share >= self.similarity and share > found.get(key, (0.0, 0))[0]:
                    found[key] = (share, at)
        return [(i, at, share) for (_, i), (share, at) in sorted(found.items())]

    def shorter(self, w: spans.Words, h: np.ndarray, n: int, hits: np.ndarray, found: dict[tuple[int, int], tuple[float, int]]) -> None:
        """Adds documents of less than n words that are similar to items of n words."""
        k = min(SHINGLE, n)
        need = int(np.ceil(self.similarity * (n - k + 1) - 1e-9))
        size = np.diff(w.first)
        docs = np.flatnonzero((size < n) & (size - k + 1 >= need))
        docs = docs[np.searchsorted(hits, w.first[docs + 1]) - np.searchsorted(hits, w.first[docs]) >= need]
        if not len(docs):
            return
        prints = np.concatenate([fingerprint(h[w.first[d] : w.first[d + 1]]) for d in docs])
        for at, i in zip(*(x.tolist() for x in self.near(prints, n))):
            d = int(docs[at])
            a, b = int(w.first[d]), int(w.first[d + 1])
            share = common(shingle_hashes(h, np.arange(a, b - k + 1), k), self.shingles[i]) / (n - k + 1)
            if share >= self.similarity:
                found[d, i] = (share, a)

    def candidates(self, w: spans.Words, n: int, hits: np.ndarray) -> np.ndarray:
        """Starts of windows of n words with enough shared shingles (hits: where those start, sorted)."""
        if not len(hits):
            return hits
        shingles = n - min(SHINGLE, n) + 1
        need = int(np.ceil(self.similarity * shingles - 1e-9))
        # a window with enough hits starts at most so far before the first of them
        ahead = np.searchsorted(hits, hits + shingles) - np.arange(len(hits))
        first = hits[ahead >= need]
        s = np.unique((first[:, None] - np.arange(shingles - need + 1)[None, :]).reshape(-1))
        s = s[s >= 0]
        s = s[s + n <= w.first[w.doc[s] + 1]]
        return s[np.searchsorted(hits, s + shingles) - np.searchsorted(hits, s) >= need]


def stretches(starts: np.ndarray, longest: int):
    """(first start, start after the last, end of the words) of groups of
    starts of windows, each of bounded length and without wide gaps."""
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + STRETCH))
        gap = np.flatnonzero(np.diff(starts[lo:hi]) > longest)
        hi = lo + int(gap[0]) + 1 if len(gap) else hi
        yield int(starts[lo]), int(starts[hi - 1]) + 1, int(starts[hi - 1]) + longest
        lo = hi


def indexes(benchmark: DataFrame, item_col: str, text_col: str, radius: int, similarity: float):
    """(index as a broadcast, whether more follow), one a block of items; a
    block is bounded in items and bytes."""
    rows = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-2 * n // ITEMS), -(-2 * size // BYTES))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        part = part.toArrow().combine_chunks()
        ids, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (part["id"], part["text"]))
        shared = benchmark.sparkSession.sparkContext.broadcast(Index.build(ids, texts, radius, similarity))
        yield shared, k + 1 < blocks
        if k + 1 < blocks:
            shared.destroy()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, item, start, similarity): one row for each document row and item it holds."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("item", benchmark.schema[item_col].dataType), StructField("start", LongType()), StructField("similarity", DoubleType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for index, more in indexes(benchmark, item_col, item_text_col, radius, similarity):

        def run(batches, index=index):
            for batch in batches:
                found = list(index.value.matches(batch.column("text")))
                if found:
                    doc, item, start, share = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), index.value.ids.take(pa.array(item)), pa.array(start, pa.int64()), pa.array(share, pa.float64())], ["id", "item", "start", "similarity"])

        found = source.mapInArrow(run, schema)
        out = out.unionByName(scratch.staged(found, "matches") if more else found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def without(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    at = docs.columns.index(text_col)
    for index, more in indexes(benchmark, item_col, item_text_col, radius, similarity):

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in index.value.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        docs = scratch.staged(docs, "without") if more else docs
    return docs
