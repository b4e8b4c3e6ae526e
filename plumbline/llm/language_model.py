"""Language-model scores from a log-frequency Bloom filter.

N-grams of up to ``order`` tokens are counted over the training documents
(words with A-Z in lower case, then one end token a document). All words are
kept, and all longer n-grams from ``min_count`` occurrences on, however large
the corpus. Counts are quantised by logarithms: an n-gram of level q enters a
Bloom filter as the q keys (n-gram, 1) to (n-gram, q), and repeated membership
probes, level by level up to the first miss, give it back. Trigrams are counted
where the filter has both their bigrams, which loses none.

The filter is built in parts by n-gram hash, where the counts are. Parts are
gathered into shards of about ``SHARD`` bytes, each passes through the driver
alone and is broadcast; what it leaves in the driver's JVM is collected before
the next. Tasks probe shard after shard for a stretch of texts and hold one at
a time, if they don't all fit into ``ROOM``. Filters and contexts are broadcast
apart, as they are looked up apart, and contexts are sent as whole numbers.

Probabilities are smoothed by absolute discounting: what a context's kept
continuations leave goes to the shorter context, down to the unigrams, of which
a small share goes to words not seen. The sums of the decoded counts and the
numbers of continuations, which normalise them, go with the shards as sorted
arrays; they are summed from what the finished filter gives back. So the
probabilities of all words behind a context sum to one, but for false positives
of level 1, one in a million probes.

The add-0.1 unigram base needs the exact count of every token: frequent ones
(a relative frequency of 2**-KEPT, so at most 2**KEPT words) are broadcast, all
others meet their counts in a shuffle of one row per task and bucket of hashes.

Null texts are empty: they have the end token alone. Null ids count as "".
Very long texts count like others; one must fit into a task's memory. Repeated
rows count and are scored each; ties don't arise. Other columns are not carried
and may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import scratch, spans
from plumbline.llm.spans import U64

KEPT = 20  # bits: a word's count is broadcast for the base from a relative frequency of 2**-KEPT
BASE = 2.0  # of the levels
MIN_COUNT = 2  # of n-grams of two tokens and more
PROBES = (20, 7)  # hash functions of a key of level 1, which tells whether an n-gram is there, and of higher levels
BITS = 1.45  # of the filter for each hash function of each key
GATE = 4  # hash functions that tell whether an n-gram may be there
SHARD, ROOM = 16 << 20, 64 << 20  # bytes of a shard, and of all shards that a worker keeps
LOW, LOW_BITS = U64((1 << 48) - 1), U64(48)  # what tells keys of one bucket apart
DISCOUNT = 0.75
ADD = 0.1  # of the unigram base
HELD = 1 << 19  # distinct keys that a counting task holds before it passes them on
RUN = 1 << 14  # keys that are probed at a time, so that what belongs to them stays in the processor's cache
END = spans.mix(np.zeros(1, U64), 99)[0]
ODD = tuple(U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def tokens(texts: pa.Array, target: int = 1 << 21):
    """(words, hashes, first): hashes of all tokens of each piece, ends included."""
    for w in spans.words(texts, lower=True, target=target):
        n = np.diff(w.first)
        first = w.first + np.arange(len(w.first))
        out = np.full(int(first[-1]), END, U64)
        out[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = w.hashes()
        yield w, out, first


def level(count: np.ndarray, floor: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, floor) / floor) / np.log(BASE) + 1e-9).astype(np.int64)


def decoded(q: np.ndarray, floor: float) -> np.ndarray:
    return np.where(q > 0, floor * BASE ** (q - 0.5), 0.0)


def gram_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """Of one token its own hash."""
    total = hashes[0]
    for k, h in enumerate(hashes[1:]):
        total = spans.mix(total * ODD[0] + h, k + 1)
    return total


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    return spans.bucket_of(spans.mix(h, 5), n)


@dataclass
class Shard:
    """Bloom filters of the buckets lo to hi - 1 over (key, level), one behind
    another."""

    lo: int
    hi: int
    start: np.ndarray  # of each bucket, in bits
    size: np.ndarray
    bits: np.ndarray  # packed
    probes: tuple[int, int] = PROBES

    @staticmethod
    def places(key: np.ndarray, j: int, size, probes: int):
        a = spans.mix(key, 1000 + j)
        step = ((a >> U64(32)) | U64(1)) * ODD[1]
        for _ in range(probes):
            yield ((a & U64(0xFFFFFFFF)) * size) >> U64(32)
            a = a + step

    @classmethod
    def of_bucket(cls, b: int, key: np.ndarray, q: np.ndarray, probes: tuple[int, int]) -> Shard:
        """The filter of one bucket; key: named."""
        size = 64 * max(1, int(np.ceil((len(q) * probes[0] + int((q - 1).sum()) * probes[1]) * BITS / 64)))
        on = np.zeros(size, bool)
        for j in range(1, int(q.max(initial=0)) + 1):
            for at in cls.places(key[q >= j], j, U64(size), probes[j > 1]):
                on[at.astype(np.int64)] = True
        return cls(b, b + 1, np.zeros(1, U64), np.array([size], U64), np.packbits(on, bitorder="little"), probes=probes)

    def has(self, key: np.ndarray, start: np.ndarray, size: np.ndarray, j: int, probes: int) -> np.ndarray:
        out = np.zeros(len(key), bool)
        for i in range(0, len(key), RUN):
            own = slice(i, i + RUN)
            out[own] = self.run_has(key[own], start[own], size[own], j, probes)
        return out

    def run_has(self, key: np.ndarray, start: np.ndarray, size: np.ndarray, j: int, probes: int) -> np.ndarray:
        out = np.zeros(len(key), bool)
        left = np.flatnonzero(size > 0)
        a = spans.mix(key[left], 1000 + j)
        step = ((a >> U64(32)) | U64(1)) * ODD[1]
        start, size, all_ = start[left], size[left], np.ones(len(left), bool)
        for _ in range(probes):
            at = a & U64(0xFFFFFFFF)
            at *= size
            at >>= U64(32)
            at += start
            byte = self.bits.take((at >> U64(3)).view(np.int64))
            at &= U64(7)
            byte >>= at.astype(np.uint8)
            byte &= 1
            all_ &= byte.view(bool)
            n = np.count_nonzero(all_)
            if not n:
                return out
            if n < 0.8 * len(all_):  # a few that missed cost less than new arrays
                left, a, step, start, size = left[all_], a[all_], step[all_], start[all_], size[all_]
                all_ = np.ones(n, bool)
            a += step
        out[left[all_]] = True
        return out

    def maybe(self, h: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which are in the filter or, for a few, seem so."""
        return self.has(named(h, b), self.start[b - self.lo], self.size[b - self.lo], 1, min(GATE, self.probes[0]))

    def levels(self, h: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Repeated probes, up to the first miss; b: the buckets of h."""
        key, start, size = named(h, b), self.start[b - self.lo], self.size[b - self.lo]
        out, left, j = np.zeros(len(h), np.int64), np.arange(len(h)), 1
        while len(left):
            left = left[self.has(key[left], start[left], size[left], j, self.probes[j > 1])]
            out[left] = j
            j += 1
        return out


def distinct(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, their buckets, where each of h is among them), by bucket and
    lower bits, which is all that filters and contexts know of a hash. In this
    order one shard's hashes are a slice, and its memory is read from one end to
    the other."""
    b, low = bucket(h, n), h & LOW
    order = np.argsort((b.astype(U64) << LOW_BITS) | low) if n <= 1 << 16 else np.lexsort((low, b))
    b, low = b[order], low[order]
    new = np.ones(len(h), bool)
    new[1:] = (low[1:] != low[:-1]) | (b[1:] != b[:-1])
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return h[order[new]], b[new], back


def named(h: np.ndarray, b) -> np.ndarray:
    """What stands for a key in the filter: its bucket and its lower bits."""
    return spans.mix((h & LOW) * ODD[2] + np.asarray(b).astype(U64), 8)


@dataclass
class Contexts:
    """The contexts of the buckets from lo on."""

    lo: int
    unit: float  # of the totals: they are sums of decoded counts, which are its multiples
    key: np.ndarray  # bucket - lo, then the key's lower bits; sorted
    total: np.ndarray  # decoded counts of a context's kept continuations, in units
    more: np.ndarray  # numbers of these continuations

    @classmethod
    def of(cls, lo: int, least: float, key: np.ndarray, z: np.ndarray, m: np.ndarray) -> Contexts:
        unit = float(decoded(np.ones(1, np.int64), least)[0])
        return cls(lo, unit, key, narrow(np.rint(z / unit).astype(U64)), narrow(m.astype(U64)))

    def __getstate__(self) -> tuple:
        """Keys without the zeros that their buckets begin with."""
        return self.lo, self.unit, np.bincount((self.key >> LOW_BITS).astype(np.int64)), spans.pack(self.key & LOW, 6), self.total, self.more

    def __setstate__(self, state: tuple) -> None:
        self.lo, self.unit, counts, keys, self.total, self.more = state
        self.key = spans.unpack(keys, 6)
        self.key |= np.repeat(np.arange(len(counts), dtype=U64) << LOW_BITS, counts)

    def find(self, h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals and the shares of the shorter context; 0 and 1 where unknown."""
        at = place_of(self.key, ((b - self.lo).astype(U64) << LOW_BITS) | (h & LOW))
        total, rest = np.zeros(len(h)), np.ones(len(h))
        found = at >= 0
        total[found] = self.total[at[found]] * self.unit
        rest[found] = DISCOUNT * self.more[at[found]] / np.maximum(total[found], 1e-300)
        return total, rest


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes each, if that holds them."""
    return x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x


@dataclass
class Model:
    """What scoring needs; shards come as broadcasts, by order of n-grams."""

    shards: list[list]  # of each order
    known: list[list]  # contexts in the buckets of these shards; words have none
    bounds: list[list[int]]  # first buckets of these shards
    n: int  # buckets
    min_count: int
    words: float  # sum of the decoded counts of all words
    distinct: int
    unseen: float  # share of words not seen
    keep: bool  # whether workers keep all shards
    probes: tuple[int, int]

    def each(self, k: int, b: np.ndarray, shards: list[list]):
        """(shard, the slice of b that is its own); b: buckets in ascending order."""
        cut = np.searchsorted(b, [*self.bounds[k], self.n])
        for shared, lo, hi in zip(shards[k], cut, cut[1:]):
            if lo < hi:
                shard = shared.value
                if not self.keep:
                    del shared._value  # only this name holds it
                yield shard, slice(lo, hi)

    def counts(self, k: int, h: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Decoded counts of n-grams of k + 1 tokens; h, b: from distinct, as below."""
        q = np.zeros(len(h), np.int64)
        for shard, own in self.each(k, b, self.shards):
            q[own] = shard.levels(h[own], b[own])
        return decoded(q, self.min_count if k else 1)

    def maybe(self, k: int, h: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which n-grams of k + 1 tokens may be kept ones."""
        out = np.zeros(len(h), bool)
        for shard, own in self.each(k, b, self.shards):
            out[own] = shard.maybe(h[own], b[own])
        return out

    def contexts(self, k: int, h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals and rests of contexts of k tokens; 0 and 1 where unknown."""
        total, rest = np.zeros(len(h)), np.ones(len(h))
        for some, own in self.each(k, b, self.known):
            total[own], rest[own] = some.find(h[own], b[own])
        return total, rest

    def probabilities(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token, given those before it in its document."""
        u, b, back = distinct(h, self.n)
        p = ((1 - self.unseen) * self.counts(0, u, b) / max(self.words, 1e-300) + self.unseen / (self.distinct + 1))[back]
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        before = np.arange(len(h))  # of each token, where the n-gram that ends there is among those of the order before
        for k in range(1, len(self.shards)):
            # an n-gram of one order is the context of the next token's n-gram
            total, rest = self.contexts(k, u, b)
            at = np.flatnonzero(place >= k)
            of = back[before[at - 1]]
            at, of = at[total[of] > 0], of[total[of] > 0]
            if not len(at):
                break
            total, rest = total[of], rest[of]
            u, b, back = distinct(gram_hash([h[at - i] for i in range(k, -1, -1)]), self.n)
            seen = np.maximum(self.counts(k, u, b)[back] - DISCOUNT, 0.0)
            p[at] = np.minimum(seen / total, 1 - rest) + rest * p[at]  # no n-gram has more than all behind its context
            if k + 1 < len(self.shards):
                before = np.full(len(h), len(at))
                before[at] = np.arange(len(at))
                place = np.where(np.r_[len(at), before[:-1]] < len(at), place, 0)  # contexts that were not looked for are unknown
        return p


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    run = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[run], np.add.reduceat(counts[order], run) if len(run) else counts[:0]


def flushed(batches, keys_of, add, rows_of):
    """Rows of what keys_of finds, added up until HELD distinct keys are held."""
    parts, held = [], 0
    for batch in batches:
        for part in keys_of(batch.column("text")):
            parts.append(part)
            held += len(part[0])
            if held > HELD:
                parts = [add(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield rows_of(*parts[0])
                    parts, held = [], 0
    if held:
        yield rows_of(*add(parts))


def by_rows(b: np.ndarray, *columns: tuple[np.ndarray, int | str]) -> pa.RecordBatch:
    """One row a bucket; columns are packed to a number of bytes or a type."""
    order = np.argsort(b, kind="stable")
    b = b[order]
    rows = [(x, *(spans.pack(c[order[at]], t) if isinstance(t, int) else c[order[at]].astype(t).tobytes() for c, t in columns)) for x, at in spans.by_bucket(b)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] + [pa.binary()] * len(columns))], ["bucket", *"abc"[: len(columns)]])


def numbers(table: pa.Table, name: str, kind: int | str) -> np.ndarray:
    values = [x.as_buffer().to_pybytes() for x in table[name] if x.is_valid]
    return np.concatenate([np.zeros(0, U64 if isinstance(kind, int) else kind)] + [spans.unpack(x, kind) if isinstance(kind, int) else np.frombuffer(x, kind) for x in values])


def counted(train: DataFrame, n: int, probes: tuple[int, int] = PROBES) -> DataFrame:
    """Exact counts of all tokens: one row a bucket, of sorted keys and counts, and their filter."""

    def found(texts):
        for _, h, _ in tokens(texts):
            yield np.unique(h, return_counts=True)

    def add(parts):
        return merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def total(table: pa.Table) -> pa.Table:
        k, c = merged(numbers(table, "a", "<u8"), numbers(table, "b", "<u4").astype(np.int64))
        b = np.full(len(k), table["bucket"][0].as_py())
        made = Shard.of_bucket(int(b[0]), named(k, b), level(c, 1), probes)
        return pa.table({"bucket": table["bucket"][:1], "keys": pa.array([k.tobytes()]), "counts": pa.array([c.tobytes()]), "distinct": pa.array([len(k)]), "total": pa.array([int(c.sum())]), "size": pa.array([int(made.size[0])]), "bits": pa.array([made.bits.tobytes()]), "decoded": pa.array([float(decoded(made.levels(k, b), 1).sum())])})

    rows = train.mapInArrow(lambda batches: flushed(batches, found, add, lambda k, c: by_rows(bucket(k, n), (k, "<u8"), (c, "<u4"))), "bucket long, a binary, b binary")
    return rows.repartition(n, "bucket").groupBy("bucket").applyInArrow(total, "bucket long, keys binary, counts binary, distinct long, total long, size long, bits binary, decoded double")


def grams(train: DataFrame, k: int, model: Model) -> DataFrame:
    """Filters of n-grams of k + 1 tokens, one row a bucket, and rows with what
    each bucket's n-grams add to their contexts (ctx_bucket, ctx, z, m)."""
    n, least, probes, stretch = model.n, model.min_count, model.probes, (2 if model.keep else 4) << 20

    def found(texts):
        for _, h, first in tokens(texts, stretch):
            at = np.flatnonzero(np.arange(len(h)) - np.repeat(first[:-1], np.diff(first)) >= k)
            if k > 1 and least > 1:
                u, b, back = distinct(gram_hash([h[:-1], h[1:]]) if k == 2 else gram_hash([h[i : len(h) - k + 1 + i] for i in range(k)]), n)
                kept = model.maybe(k - 1, u, b)[back]  # the n-grams of k tokens, by their first
                at = at[kept[at - k] & kept[at - k + 1]]
            g, first_at, c = np.unique(gram_hash([h[at - i] for i in range(k, -1, -1)]), return_index=True, return_counts=True)
            yield g, c, gram_hash([h[at[first_at] - i] for i in range(k, 0, -1)])

    def add(parts):
        g, c, ctx = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(g, kind="stable")
        g = g[order]
        run = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else order
        return g[run], np.add.reduceat(c[order], run) if len(g) else c, ctx[order[run]]

    def rows_of(g, c, ctx):
        return by_rows(bucket(g, n), (g & LOW, 6), (c, "<u4"), (ctx, "<u8"))

    def total(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        g, c, ctx = add([(numbers(table, "a", 6), numbers(table, "b", "<u4").astype(np.int64), numbers(table, "c", "<u8"))])
        g, c, ctx = g[c >= least], c[c >= least], ctx[c >= least]
        in_b = np.full(len(g), b)
        made = Shard.of_bucket(b, named(g, in_b), level(c, least), probes)
        u, back = np.unique(ctx, return_inverse=True)
        z, m = np.bincount(back, decoded(made.levels(g, in_b), least), len(u)), np.bincount(back, minlength=len(u))
        own = by_rows(bucket(u, n), (u & LOW, 6), (z, "<f8"), (m, "<u4")) if len(u) else None
        some = own.num_rows if own is not None else 0
        null = lambda t: pa.nulls(some, t)
        columns = [(pa.int64(), b, null(pa.int64())), (pa.int64(), int(made.size[0]), null(pa.int64())), (pa.binary(), made.bits.tobytes(), null(pa.binary()))]
        out = [pa.concat_arrays([pa.array([x], t), rest]) for t, x, rest in columns]
        out += [pa.concat_arrays([pa.array([None], t), own.column(i) if own is not None else pa.nulls(0, t)]) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
        return pa.table(out, names=["bucket", "size", "bits", "ctx_bucket", "ctx", "z", "m"])

    rows = train.mapInArrow(lambda batches: flushed(batches, found, add, rows_of), "bucket long, a binary, b binary, c binary")
    return rows.repartition(n, "bucket").groupBy("bucket").applyInArrow(total, "bucket long, size long, bits binary, ctx_bucket long, ctx binary, z binary, m binary")


def contexts(made: DataFrame, n: int) -> DataFrame:
    """One row a bucket of contexts: sorted lower bits of keys, sums, numbers of continuations."""

    def total(table: pa.Table) -> pa.Table:
        key, z, m = numbers(table, "ctx", 6), numbers(table, "z", "<f8"), numbers(table, "m", "<u4")
        u, back = np.unique(key, return_inverse=True)
        return pa.table({"bucket": table["bucket"][:1], "ctx": pa.array([u.tobytes()]), "z": pa.array([np.bincount(back, z, len(u)).tobytes()]), "m": pa.array([np.bincount(back, m, len(u)).tobytes()])})

    rows = made.where("ctx_bucket is not null").select(F.col("ctx_bucket").alias("bucket"), "ctx", "z", "m")
    return rows.repartition(n, "bucket").groupBy("bucket").applyInArrow(total, "bucket long, ctx binary, z binary, m binary")


def shards_of(filters: DataFrame, own_contexts: DataFrame | None, n: int, least: int, probes: tuple[int, int]) -> tuple[list, list, list[int], int]:
    """Broadcast shards and contexts, their first buckets, and their bytes; one
    at a time passes through the driver."""
    spark = filters.sparkSession
    size = np.zeros(n, np.int64)
    for r in filters.select("bucket", F.octet_length("bits").alias("n")).collect():
        size[r["bucket"]] += r["n"]
    if own_contexts is not None:
        for r in own_contexts.select("bucket", F.octet_length("ctx").alias("n")).collect():
            size[r["bucket"]] += 4 * r["n"]
    out, known, bounds, lo = [], [], [], 0
    while lo < n:
        hi = max(lo + 1, min(lo + 65536, int(np.searchsorted(np.cumsum(size[lo:]), SHARD, "right")) + lo))
        within = F.col("bucket").between(lo, hi - 1)
        rows = sorted(filters.where(within).select("bucket", "size", "bits").collect())
        bits, start = np.zeros(hi - lo, U64), np.zeros(hi - lo, U64)
        at = 0
        for r in rows:
            start[r["bucket"] - lo], bits[r["bucket"] - lo], at = at, r["size"], at + r["size"]
        shard = Shard(lo, hi, start, bits, np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8), probes=probes)
        out.append(spark.sparkContext.broadcast(shard))
        del rows, bits, shard
        if own_contexts is not None:
            scratch.collect_garbage(spark, at_once=True)
            rows = sorted(own_contexts.where(within).collect())
            key = np.concatenate([np.zeros(0, U64)] + [(U64(r["bucket"] - lo) << LOW_BITS) | np.frombuffer(r["ctx"], "<u8") for r in rows])
            z, m = (np.concatenate([np.zeros(0)] + [np.frombuffer(r[c], "<f8") for r in rows]) for c in "zm")
            known.append(spark.sparkContext.broadcast(Contexts.of(lo, least, key, z, m)))
            del rows, key, z, m
        bounds.append(lo)
        scratch.collect_garbage(spark, at_once=True)  # arrays of megabytes, for which the heap would grow
        lo = hi
    return out, known, bounds, int(size.sum())


def collected(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) from ``least`` on, sorted by key; 2**KEPT at most by the choice of least."""

    def frequent(batches):
        for batch in batches:
            for keys, c in zip(batch.column("keys"), batch.column("counts")):
                k, c = np.frombuffer(keys.as_buffer(), "<u8"), np.frombuffer(c.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([k[c >= least].tobytes()]), pa.array([c[c >= least].tobytes()])], ["keys", "counts"])

    rows = counts.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").collect()
    k = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in rows] or [np.zeros(0, U64)])
    c = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(k)
    return k[order], c[order]


def place_of(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in the sorted keys, -1 where it isn't among them."""
    if not len(keys):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def train(docs: DataFrame, counts: DataFrame, n: int, order: int, min_count: int, probes: tuple[int, int] = PROBES) -> Model:
    """The model; docs: (text) of the training documents, counts: those of their tokens."""
    total, distinct, words = (x or 0 for x in counts.agg(F.sum("total"), F.sum("distinct"), F.sum("decoded")).first())
    shards, _, bounds, size = shards_of(counts, None, n, 1, probes)
    model = Model([shards], [[]], [bounds], n, min_count, float(words), distinct, ADD * (distinct + 1) / max(total + ADD * (distinct + 1), 1e-300), size <= ROOM, probes)
    for k in range(1, order):
        made = scratch.staged(grams(docs, k, model), f"grams-{k + 1}")
        own = scratch.staged(contexts(made, n), f"contexts-{k}")
        shards, known, bounds, more = shards_of(made.where("bits is not null"), own, n, min_count, probes)
        scratch.discard(made)
        scratch.discard(own)
        size += more
        model = replace(model, shards=[*model.shards, shards], known=[*model.known, known], bounds=[*model.bounds, bounds], keep=size <= ROOM)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = 3, min_count: int = MIN_COUNT, probes: tuple[int, int] = PROBES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row; rows with crc32(id as text) mod folds = 0 are held out."""
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    training = rows.where("not held_out").select("text")
    n = scratch.buckets_for(spark, scratch.text_bytes(rows))
    counts = scratch.staged(counted(training, n, probes), "tokens")
    model = train(training, counts, n, order, min_count, probes)
    total, distinct = (x or 0 for x in counts.agg(F.sum("total"), F.sum("distinct")).first())
    words, word_counts = collected(counts, max(1, -(-total >> KEPT)))
    bottom = np.log10(total + ADD * (distinct + 1)) if total else 0.0
    shared = spark.sparkContext.broadcast((words, np.log10(word_counts + ADD) - bottom))
    stretch = (2 if model.keep else 4) << 20  # bytes of text for which all shards are looked through

    def passed(batches):
        words, logs = shared.value
        chunk, no = uuid.uuid4().int >> 65, 0
        rare, rare_docs, held = [], [], 0

        def sent(kind):
            """Tokens that aren't frequent meet their counts elsewhere."""
            rest, doc = np.concatenate(rare), np.concatenate(rare_docs)
            out = by_rows(bucket(rest, n), (rest, "<u8"), (doc, "<i8"))
            some = out.num_rows
            null = lambda t: pa.nulls(some, t)
            return pa.RecordBatch.from_arrays([pa.array(np.full(some, chunk)), null(pa.int64()), null(kind), null(pa.bool_()), null(pa.int64()), null(pa.int64()), null(pa.float64()), null(pa.float64()), *out.columns], NAMES)

        for batch in batches:
            for w, h, first in tokens(batch.column("text"), stretch):
                m = w.hi - w.lo
                doc = np.repeat(np.arange(m), np.diff(first))
                u, back = np.unique(h, return_inverse=True)
                at = place_of(words, u)[back]
                known = at >= 0
                base = np.bincount(doc[known], logs[at[known]], m) if len(words) else np.zeros(m)
                own = np.bincount(doc, np.log10(model.probabilities(h, first)), m)
                n_known = np.bincount(doc[known], minlength=m)
                ids, held_out = (batch.column(c).slice(w.lo, m) for c in ("id", "held_out"))
                none = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array(np.arange(no, no + m)), ids, held_out, pa.array(np.diff(first)), pa.array(n_known), pa.array(base), pa.array(own), pa.nulls(m, pa.int64()), none, none], NAMES)
                rare.append(h[~known])
                rare_docs.append(doc[~known] + no)
                held, no = held + len(rare[-1]), no + m
                if held > HELD:
                    yield sent(ids.type)
                    rare, rare_docs, held = [], [], 0
        if held:
            yield sent(ids.type)

    kind = docs.schema[id_col].dataType.simpleString()
    both = scratch.staged(rows.mapInArrow(passed, f"chunk long, no long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, bucket long, keys binary, docs binary"), "scores")

    def meet(tokens: pa.Table, known: pa.Table) -> pa.Table:
        if known.num_rows:
            words, c = (np.frombuffer(known[k][0].as_buffer(), t) for k, t in (("keys", "<u8"), ("counts", "<i8")))
        else:
            words, c = np.zeros(0, U64), np.zeros(0, np.int64)
        out = []
        for chunk, keys, docs in zip(tokens["chunk"], tokens["keys"], tokens["docs"]):
            k, d = np.frombuffer(keys.as_buffer(), "<u8"), np.frombuffer(docs.as_buffer(), "<i8")
            at = place_of(words, k)
            found = np.where(at >= 0, c[at] if len(c) else 0, 0)
            u, back = np.unique(d, return_inverse=True)
            known_n, part = np.bincount(back, found > 0, len(u)).astype("<i8"), np.bincount(back, np.log10(found + ADD) - bottom, len(u))
            out.append((chunk.as_py(), u.tobytes(), known_n.tobytes(), part.tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else ((),) * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["chunk", "no", "known", "part"])

    def back_to_documents(table: pa.Table) -> pa.Table:
        """Sums for the documents of one task, whose parts come packed from each bucket."""
        no, known, part = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[k]]) for k, t in (("no", "<i8"), ("known", "<i8"), ("part", "<f8")))
        u, at = np.unique(no, return_inverse=True)
        return pa.table({"chunk": pa.array(np.full(len(u), table["chunk"][0].as_py())), "no": pa.array(u), "known": pa.array(np.bincount(at, known, len(u)).astype(np.int64)), "part": pa.array(np.bincount(at, part, len(u)))})

    rest = both.where("bucket is not null").select("bucket", "chunk", "keys", "docs")
    met = rest.groupBy("bucket").cogroup(counts.select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(meet, "chunk long, no binary, known binary, part binary")
    sums = met.groupBy("chunk").applyInArrow(back_to_documents, "chunk long, no long, known long, part double")
    out = both.where("bucket is null").drop("bucket", "keys", "docs").join(sums, ["chunk", "no"], "left")
    zero = F.lit(0)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("part", F.lit(0.0))).alias("base_score"), "score",
    )


NAMES = ["chunk", "no", "id", "held_out", "n_tokens", "n_known", "base", "score", "bucket", "keys", "docs"]
