"""Near-duplicates by Order MinHash.

Texts are words (A-Z in lower case). Each distinct text's 5-word shingles,
labelled by their occurrence, are sampled once a band: the ``TAKE`` smallest
under the band's hash, kept in text order. Texts that agree on a band's ordered
sample are candidates. Pairs are verified by banded alignment: their longest
common subsequence must have ``similarity`` of the longer text's words. No
such alignment leaves the band of (1 - similarity) of that length, so the band
loses nothing. Two shingles a sample and 28 samples find 0.9 or more of the
pairs whose words were replaced at random, up to the 0.15 that the default
similarity of 0.85 allows; ``tests/llm`` measures that against all pairs.

Groups of candidates may hold any share of all rows, so their pairs are never
listed. Each group has a hub, its first text; members are verified against
it, first against one hub each, then against those that aren't yet in the same
class. What stays apart from its hub is compared with all others of its group
that are of another class, those of the hub's class too: small groups in one
task each, large ones in cells of about ROOM texts of like length, or fewer
long ones. So each pair
of candidates is decided, in groups of any size. The work of a group of texts
that share a sample, but aren't alike, grows with the square of those of like
length; it is cut short by lengths, word counts and links found before.
Classes are the connected components, found by contraction, one table a round.

Rows without words (null and empty texts too) are copies of each other.
Repeated rows are copies. Very long texts are sketched in stretches and aligned
whole. The smallest id names a class; where ids tie or are null, ``keep_one``
takes the smallest hash of the row. Other columns, of any name, are not carried
by ``classes``; ``keep_one`` keeps all. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import scratch, spans
from plumbline.llm.spans import U64

SHINGLE, SIMILARITY = 5, 0.85
TAKE, BANDS = 2, 28  # shingles of a sample, and samples
LOUD = 10_000  # rows of one text or class from which a join broadcasts it
ROOM, ROOM_WORDS = 512, 1 << 20  # texts of a cell, and words of all of them
BAG = 256  # columns of the word counts that bound a pair's common subsequence
CHUNK = 1 << 16  # shingles that are hashed for all bands at once
ODD = U64(0x9E3779B97F4A7C15)


def seeds(bands: int) -> np.ndarray:
    return spans.mix(np.arange(bands, dtype=U64), 200) | U64(1)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of shingles, the second and later occurrences told apart."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.r_[False, s[1:] == s[:-1]]
    if not same.any():
        return h
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(same, 0, at))
    out = np.empty_like(h)
    out[order] = np.where(nth > 0, spans.mix(s + nth.astype(U64) * ODD, 3), s)
    return out


def smallest(own: np.ndarray, take: int) -> np.ndarray:
    """Places of each row's ``take`` smallest values (all, if there are no more).
    Rows are uniform hashes, so a threshold leaves a few times as many to sort;
    where it leaves too few in any row, all are partitioned."""
    bands, n = own.shape
    if n <= take:
        return np.broadcast_to(np.arange(n), (bands, n))
    if n > 8 * take:
        row, col = np.nonzero(own < U64((1 << 64) // n * 3 * take))
        count = np.bincount(row, minlength=bands)
        if count.min() >= take:
            first = np.cumsum(count) - count
            order = np.lexsort((own[row, col], row))
            return col[order[first[:, None] + np.arange(take)[None, :]]]
    return np.argpartition(own, take - 1, axis=1)[:, :take]


def sample(h: np.ndarray, take: int, seed: np.ndarray) -> np.ndarray:
    """One key a band: the band's smallest shingles, in text order."""
    best = None
    for lo in range(0, len(h), CHUNK):
        part = np.arange(lo, min(lo + CHUNK, len(h)))
        own = h[None, part] * seed[:, None]
        at = smallest(own, take)
        value, at = np.take_along_axis(own, at, 1), part[at]
        if best is not None:
            value, at = np.concatenate((best[0], value), 1), np.concatenate((best[1], at), 1)
            if value.shape[1] > take:
                low = np.argpartition(value, take - 1, axis=1)[:, :take]
                value, at = np.take_along_axis(value, low, 1), np.take_along_axis(at, low, 1)
        best = value, at
    g = h[np.sort(best[1], axis=1)]
    key = seed.copy()
    for c in range(g.shape[1]):
        key = spans.mix(key * ODD + g[:, c], 4)
    return key


def sketches(rows: DataFrame, columns: str) -> DataFrame:
    """rows (ending with text) with node, n (words) and keys: one key a band,
    none for texts without words."""
    seed, take = seeds(BANDS), TAKE

    def run(batches):
        for batch in batches:
            for w in spans.words(batch.column("text"), lower=True):
                h, m = w.hashes(), w.hi - w.lo
                n = np.diff(w.first)
                node = b"".join(blake2b(spans.normal(w, i), digest_size=16).digest() for i in range(m))
                starts = w.window_starts(SHINGLE)
                shingles = spans.window_hash(h, SHINGLE)[starts]
                first = np.searchsorted(starts, w.first)
                keys = []
                for i in range(m):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    if a == b:
                        keys.append(np.zeros(0, np.int64))
                        continue
                    own = shingles[first[i] : first[i + 1]] if b - a >= SHINGLE else spans.window_hash(h[a:b], b - a)
                    keys.append(sample(labelled(own), take, seed).view(np.int64))
                off = np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                names = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * 16), pa.py_buffer(node)])
                part = batch.slice(w.lo, m)
                yield pa.RecordBatch.from_arrays([*part.columns, names, pa.array(n), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], [*part.schema.names, "node", "n", "keys"])

    return rows.mapInArrow(run, f"{columns}, node binary, n long, keys array<long>")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the common subsequence has that share of the longer text's words."""
    longer = max(len(a), len(b))
    need = int(np.ceil(similarity * longer - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    a, b, m = a[head:], b[head:], m - head
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    need -= head + tail
    if need <= 0:
        return True
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[i], cb[j]).sum()) < need:
        return False
    return banded(a.tolist(), b.tolist(), longer - need - head - tail + abs(len(a) - len(b))) >= need


def banded(a: list, b: list, width: int) -> int:
    """Longest common subsequence among pairs of places at most width apart,
    with one bit for each place of a in the band around the current place of b."""
    at: dict[int, list[int]] = {}
    for p, x in enumerate(a):
        at.setdefault(x, []).append(p)
    whole = {x: sum(1 << p for p in ps) for x, ps in at.items() if len(ps) > 16}
    lo, hi = 0, min(len(a), width)  # the band is [lo, hi)
    v, found = (1 << hi) - 1, 0
    for i, x in enumerate(b):
        if i - width > lo and lo < len(a):
            found += 1 - (v & 1)
            v >>= 1
            lo += 1
        if hi < len(a) and hi <= i + width:
            v |= 1 << (hi - lo)
            hi += 1
        if x in whole:
            m = (whole[x] >> lo) & ((1 << (hi - lo)) - 1)
        else:
            m = 0
            ps = at.get(x, ())
            for p in ps[bisect_left(ps, lo) :] if ps else ():
                if p >= hi:
                    break
                m |= 1 << (p - lo)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & ((1 << (hi - lo)) - 1)
    return found + (hi - lo) - v.bit_count()


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for w in spans.words(texts, lower=True):
        h = w.hashes()
        out += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    return out


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are alike."""

    def run(batches):
        for batch in batches:
            ok = [alike(x, y, similarity) for x, y in zip(word_hashes(batch.column("text_a")), word_hashes(batch.column("text_b")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b)."""
    labels, round_ = None, 0
    while True:
        ends = edges.select(F.col("a").alias("node"), F.least("a", "b").alias("low")).unionByName(edges.select(F.col("b").alias("node"), F.least("a", "b").alias("low")))
        parent = scratch.staged(ends.groupBy("node").agg(F.min("low").alias("up")), f"parents-{round_}")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            up = parent.select(F.col("node").alias("label"), "up")
            labels = scratch.staged(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), f"labels-{round_}")
        pa_, pb = (parent.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        edges = scratch.staged(edges.join(pa_, "a").join(pb, "b").where("up_a <> up_b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct(), f"edges-{round_}")
        if edges.isEmpty():
            return labels
        round_ += 1


def in_groups(members: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) found among the members (group, cell, band, node, label) of
    each group; those of one label are linked already. Where a group has two
    cells, only pairs of both count. A pair is compared in the first band that
    it shares. A group has two cells at most; known: (node, keys, text)."""

    def run(table: pa.Table) -> pa.Table:
        nodes, labels, cells = (table[c].to_pylist() for c in ("node", "label", "cell"))
        words, band = word_hashes(table["text"]), table["band"][0].as_py()
        n = np.array([len(x) for x in words], np.int64)
        before = np.stack([x.values.to_numpy()[:band] for x in table["keys"]])
        cell = np.unique(cells, return_inverse=True)[1]
        across = cell.max() > 0
        # by columns of word hashes: what two texts have in common there is no less than their common subsequence
        bags = np.stack([np.bincount((x % U64(BAG)).astype(np.int64), minlength=BAG) for x in words]).astype(np.int32)
        order = np.argsort(n, kind="stable")
        ends = np.searchsorted(similarity * n[order] - 1e-9, n[order], "right")
        home = {x: x for x in labels}

        def root(x):
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        links = []
        for k, i in enumerate(order.tolist()):
            j = order[k + 1 : ends[k]]
            j = j[~(before[j] == before[i]).any(axis=1)]
            if across:
                j = j[cell[j] != cell[i]]
            j = j[np.minimum(bags[j], bags[i]).sum(axis=1) >= similarity * n[j] - 1e-9]
            for o in j.tolist():
                if root(labels[i]) != root(labels[o]) and alike(words[i], words[o], similarity):
                    home[root(labels[i])] = root(labels[o])
                    links.append((nodes[i], nodes[o]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    whole = members.join(known, "node").select("group", "cell", "band", "node", "label", "keys", "text")
    return whole.groupBy("group").applyInArrow(run, "a long, b long")


def links_of(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """All links that classes need among nodes (node, n, keys); texts_of gives
    (node, text) of a table of nodes at least."""
    exploded = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    hubs = exploded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    spokes = exploded.join(hubs, "key").where(F.col("node") != F.col("hub"))
    spokes = scratch.staged(spokes.select("key", "band", "node", "n", "hub", "hub_n"), "spokes")
    involved = spokes.select("node").unionByName(spokes.select(F.col("hub").alias("node"))).distinct()
    texts = texts_of(involved)
    near = spokes.where(F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n") - 1e-9)
    one = near.groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("b"))
    links = scratch.staged(verified(one, texts, similarity), "links")
    labels = components(links)

    def apart(rows: DataFrame) -> DataFrame:
        """rows (node, hub) with the labels of both, where these differ."""
        of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
        both = rows.join(of("node"), "node", "left").join(of("hub"), "hub", "left")
        both = both.withColumns({f"{x}_label": F.coalesce(f"{x}_label", x) for x in ("node", "hub")})
        return both.where("node_label <> hub_label")

    second = apart(near.select("node", "hub").distinct()).join(one.select(F.col("a").alias("node"), F.col("b").alias("hub")), ["node", "hub"], "left_anti")
    more = scratch.staged(verified(second.select(F.col("node").alias("a"), F.col("hub").alias("b")), texts, similarity), "more")
    links = links.unionByName(more)
    labels = components(links)
    # groups with strangers to their hub: these meet each other and the hub's class, as far as lengths allow
    strange = apart(spokes.select("key", "node", "n", "hub")).groupBy("key").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("hub_label").alias("hub_label"))
    named = spokes.select("key", "band", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).alias("s")
    stranger = F.col("label") != F.col("hub_label")
    near_one = F.col("n").between(similarity * F.col("least") - 1e-9, F.col("most") / similarity + 1e-9)
    rest = named.join(strange.alias("t"), (F.col("s.key") == F.col("t.key")) & (stranger | near_one))
    rest = scratch.staged(rest.select("s.key", "band", "node", "n", "label", stranger.alias("stranger")), "rest")
    sizes = rest.groupBy("key", "band").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("set"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("set_2"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("words")).where("low <> high")
    # of groups with the same members one is enough
    sizes = sizes.groupBy("size", "set", "set_2").agg(F.min(F.struct("band", "key")).alias("first"), F.max("words").alias("words")).select("first.key", ((F.col("size") > ROOM) | (F.col("words") > ROOM_WORDS)).alias("cut"))
    # what tasks need to know of a text, put together once for all its groups
    known = scratch.staged(nodes.select("node", "keys").join(texts, "node"), "known")
    small = rest.join(sizes.where("not cut"), "key").select(F.concat_ws("-", "key").alias("group"), F.lit(0).alias("cell"), "band", "node", "label")
    found = in_groups(small, known, similarity)
    large = rest.join(sizes.where("cut"), "key")
    if large.isEmpty():
        return scratch.staged(links.unionByName(found), "all")
    # cells of about ROOM texts of like length: those whose lengths allow it meet, but the hub's class not itself
    step = -math.log(min(max(similarity, 0.01), 0.999)) * 1.0001  # texts more than one step apart are not alike
    large = large.withColumn("step", F.floor(F.log("n") / step).cast("int"))
    blocks = large.groupBy("key", "step", "stranger").agg(F.ceil(F.greatest(F.count("*") / ROOM, F.sum("n") / ROOM_WORDS)).cast("int").alias("blocks"))
    name = F.concat_ws("-", "step", F.col("stranger").cast("int"), "block").alias("cell")
    dealt = large.join(blocks, ["key", "step", "stranger"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).select("key", "band", "node", "label", name)
    cells = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "step", "stranger", name)
    a, b = (cells.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("step", "stranger", "cell")]) for x in "ab")
    pairs = a.join(b, "key").where("cell_a <= cell_b and abs(step_a - step_b) <= 1 and (stranger_a or stranger_b)")
    pairs = pairs.select("key", F.concat_ws("/", "key", "cell_a", "cell_b").alias("group"), F.explode(F.array_distinct(F.array("cell_a", "cell_b"))).alias("cell"))
    met = dealt.join(pairs, ["key", "cell"]).select("group", "cell", "band", "node", "label")
    return scratch.staged(links.unionByName(found).unionByName(in_groups(met, known, similarity)), "all")


def numbered(sketched: DataFrame) -> DataFrame:
    """Staged sketches, each row with a number of its own."""
    return scratch.staged(sketched.withColumn("row_number", F.monotonically_increasing_id()), "sketches")


def labelled_nodes(rows: DataFrame, similarity: float) -> DataFrame:
    """(node, low_id, copies, label) of all distinct texts among numbered
    sketches. A text goes by the number of its first row, so that texts are
    shuffled by a unique number and copies never meet."""
    nodes = rows.groupBy("node").agg(F.min("row_number").alias("number"), F.min("id").alias("low_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = scratch.staged(nodes, "distinct")

    def texts_of(involved: DataFrame) -> DataFrame:
        return scratch.staged(rows.select(F.col("row_number").alias("node"), "text").join(involved, "node"), "texts")

    labels = components(links_of(nodes.select(F.col("number").alias("node"), "n", "keys"), texts_of, similarity)).withColumnRenamed("node", "number")
    out = scratch.staged(nodes.select("node", "number", "low_id", "copies").join(labels, "number", "left").select("node", "low_id", "copies", F.coalesce("label", "number").alias("label")), "nodes")
    scratch.discard(nodes)
    return out


def by_count(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left joined with right (one row a key) on key. Keys with more than
    LOUD rows and 2**-20 of all, by right's count, are broadcast: 2**20 of
    them at most, and left's rows of them stay where they are."""
    rows = right.agg(F.sum(count)).first()[0] or 0
    loud = right.where(F.col(count) > max(LOUD, rows >> 20))
    if loud.isEmpty():
        return left.join(right, key)
    both = left.join(F.broadcast(loud), key, "left")
    quiet = both.where(F.col(count).isNull()).select(*left.columns).join(right, key)
    return both.where(F.col(count).isNotNull()).unionByName(quiet)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size, copies) of every row: class_id is the smallest
    id of its class (null if none has any), class_size counts the rows of the
    class, copies those with the same words."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = numbered(sketches(rows, f"id {kind}, text string"))
    nodes = labelled_nodes(rows, similarity)
    whole = scratch.staged(nodes.groupBy("label").agg(F.min("low_id").alias("class_id"), F.sum("copies").alias("class_size")), "classes")
    by_node = by_count(nodes.select("node", "copies", "label"), whole, "label", "class_size").select("node", "class_id", "class_size", "copies")
    by_node = scratch.staged(by_node, "by-node")
    return by_count(rows.select("id", "node"), by_node, "node", "copies").select(F.col("id").alias(id_col), "class_id", "class_size", "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class, with all its columns: the one with the
    smallest id, then the smallest hash; null ids come last. docs is read
    twice, and whole rows are shuffled once, by two hashes of all their columns."""
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hashes = [F.xxhash64(F.to_json(row)).alias("hash"), F.xxhash64(F.lit(1), F.to_json(row)).alias("hash_2")]
    rows = docs.select(F.col(id_col).alias("id"), *hashes, F.col(text_col).alias("text"))
    rows = numbered(sketches(rows, f"id {kind}, hash long, hash_2 long, text string"))
    labels = labelled_nodes(rows, similarity).select("node", "label")
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("hash"), F.col("hash_2"))
    first = rows.groupBy("node").agg(F.min(rank).alias("first")).join(labels, "node").groupBy("label").agg(F.min("first").alias("first"))
    chosen = scratch.staged(first.select("first.hash", "first.hash_2"), "first")
    whole = docs.select(row.alias("row"), *hashes).join(chosen, ["hash", "hash_2"], "left_semi")
    return whole.dropDuplicates(["hash", "hash_2"]).select("row.*")
