"""An inverted index over chunks of text, one for all dates, with exact top k.

Chunks lie in blocks of up to ``BLOCK``. A block knows the bigrams that any of
its chunks has, in how many chunks each is, and which pairs of digits occur. So
a question's score in a block has a bound: the weights of its bigrams that the
block has, and the bonus of those of its numbers whose pairs of digits it has. A
block whose bound is below the k-th best score so far is passed over, and its
texts aren't looked at. What starts is a bar found beforehand in the blocks with
the best bounds, so the work falls with k.

Where chunks have a day of announcement, blocks are of one day, and how many chunks had a bigram by each day is kept as running counts.
The weights of any date are a lookup in these counts, and blocks of later days
are passed over. Filtering by a date before counting is the same as looking up
the counts of that date, so one index answers for all dates.

Building shuffles chunks once where they have days, and counts of bigrams once.
A search shuffles the k best of each task. Questions are a stated set that
comes in blocks of bounded number; each block passes over the index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions import text as T
from plumbline.operators import joins
from plumbline.operators.patterns import automaton, finder
from plumbline.operators.retrieval import BONUS
from plumbline.sources.staging import staged

BLOCK = 32  # chunks
QUESTIONS, STRIPE = 1024, 128  # questions of one pass over the index, and of one matrix
SEEDS = 2  # blocks a question whose chunks are scored first, to find a bar
DENSE = 4096  # bigrams up to which a stripe's matrix is taken whole
NAMES = 2048  # distinct characters of questions up to which their bigrams have a table
AT_ONCE = 256  # blocks whose bounds are found together
CLOSE = 2e-9  # scores have nine decimals
EVER = 2932896  # days up to 9999-12-31
SYMBOLS = "0123456789."
RUNS = re.compile("[0-9.]{2,}").findall
# The characters of Unicode's property White_Space.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ALL = -1  # stands in the counts for a bigram that every chunk has


@dataclass
class Index:
    blocks: DataFrame  # block, day, grams, counts, digits_lo, digits_hi, ids as arrays, texts
    counts: DataFrame  # gram, day, df: chunks with the gram (all chunks for ALL) announced by that day
    ids: list[str]
    kinds: dict = field(default_factory=dict)
    dated: bool = False


WHITE = np.array([BLANKS.match(chr(c)) is not None for c in range(0x3002)])  # the last is none
PLANE = 21  # bits of a character


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all characters of some texts but white space."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    keep = ~WHITE[np.minimum(c, len(WHITE) - 1)]
    return np.repeat(np.arange(len(texts)), [len(t) for t in texts])[keep], c[keep]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of texts without white space as sorted numbers, and how many texts have each."""
    row, c = characters(texts)
    bits = max(len(texts) - 1, 1).bit_length()
    each = np.unique(((((c[:-1] << PLANE) | c[1:]) << bits) | row[:-1])[row[:-1] == row[1:]]) >> bits
    cut = np.flatnonzero(np.append(True, each[1:] != each[:-1])[: len(each)])
    gram = each[cut]
    return ((gram >> PLANE) << 32) | (gram & ((1 << PLANE) - 1)), np.diff(np.append(cut, len(each)))


def digit_pairs(text: str) -> int:
    """Which pairs of digits and points follow each other in a text, as bits."""
    out = 0
    for run in RUNS(text):
        at = [SYMBOLS.index(c) for c in run]
        for a, b in zip(at, at[1:]):
            out |= 1 << (a * len(SYMBOLS) + b)
    return out


HALF, LOW = 61, (1 << 61) - 1  # bits of the two numbers that hold the pairs


def built(chunks: DataFrame, ids: list[str], text: str, announced: str | None = None) -> Index:
    """The index of chunks, staged. Chunks without a day of a dated index are
    never announced, so no search finds them."""
    spark, kinds = chunks.sparkSession, {c: chunks.schema[c].dataType for c in ids}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    day = F.datediff(F.col(announced).cast("date"), F.lit("1970-01-01").cast("date")) if announced else F.lit(0)
    rows = chunks.select(*ids, day.cast("int").alias("day"), F.col(text).alias("text")).where("day is not null and text is not null")
    if announced:
        # dealt by day, and a day by salt, so that a day with very many chunks goes to many tasks
        rows = rows.repartition(parts, "day", F.pmod(F.xxhash64(*ids), F.lit(parts // 8 + 1))).sortWithinPartitions("day", *ids)
    elif rows.rdd.getNumPartitions() <= parts:  # a scan of few pieces, which may be uneven
        rows = rows.repartition(parts)
    arrow = {c: to_arrow_type(k) for c, k in kinds.items()}
    names = ["block", "day", "grams", "counts", "digits_lo", "digits_hi", *ids, "texts"]

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no, held, day = TaskContext.get().partitionId() << 40, [], None

        def made() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            texts = part["text"].to_pylist()
            gram, n = gram_counts(texts)
            bits = 0
            for t in texts:
                bits |= digit_pairs(t.replace(",", ""))
            one = lambda v, kind: pa.array([v], kind)
            cols = [one(no, pa.int64()), one(day, pa.int32()), one(gram, pa.list_(pa.int64())), one(n.astype(np.int32), pa.list_(pa.int32())), one(bits & LOW, pa.int64()), one(bits >> HALF, pa.int64())]
            return pa.RecordBatch.from_arrays([*cols, *[one(part[c].to_pylist(), pa.list_(arrow[c])) for c in ids], one(texts, pa.list_(pa.string()))], names)

        for batch in batches:
            days, lo = batch.column("day").to_numpy(), 0
            while lo < batch.num_rows:
                room = BLOCK - sum(b.num_rows for b in held)
                if held and (room == 0 or days[lo] != day):
                    yield made()
                    no, held, room = no + 1, [], BLOCK
                day = int(days[lo])
                hi = min(lo + room, batch.num_rows)
                hi = lo + int(np.argmax(np.append(days[lo:hi] != day, True)))
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield made()

    schema = ", ".join(["block long, day int, grams array<long>, counts array<int>, digits_lo long, digits_hi long", *[f"`{c}` array<{k.simpleString()}>" for c, k in kinds.items()], "texts array<string>"])
    blocks = staged(rows.mapInArrow(blocked, schema), "index-blocks")
    each = F.concat(F.arrays_zip(F.col("grams").alias("gram"), F.col("counts").alias("n")), F.array(F.struct(F.lit(ALL).cast("long").alias("gram"), F.size("texts").alias("n"))))
    pairs = blocks.select("day", F.inline(each)).groupBy("gram", "day").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("gram").orderBy("day"))
    counts = staged(pairs.select("gram", "day", running.alias("df")), "index-counts")
    return Index(blocks, counts, ids, kinds, announced is not None)


@dataclass
class Stripe:
    """Some questions as one matrix: rows are bigrams, columns questions."""

    gram: np.ndarray  # sorted codes
    weight: np.ndarray  # in millionths
    root: np.ndarray  # of each question's number of bigrams, 1 at least
    until: np.ndarray  # the last day that each may see
    numbers: list[list[str]]  # each question's numbers without commas
    facts: list[str | None]
    bar: np.ndarray | None = None  # a score that each question's k-th best reaches

    def hits(self, rows: int, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Sums of weights by row of what (row, place in gram) says the rows have."""
        columns, weight = place, self.weight
        if len(self.gram) > DENSE:
            some, columns = np.unique(place, return_inverse=True)
            weight = weight[some]
        has = np.zeros((rows, len(weight)))
        has[row, columns] = 1
        return has @ weight  # whole numbers below 2**53, so the order of sums doesn't matter

    def score(self, sums: np.ndarray, extra: np.ndarray, columns=slice(None)) -> np.ndarray:
        return np.round(sums / 1e6 / self.root[columns], 9) + BONUS * extra

    def forced(self) -> tuple[list[str], list[list[int]]]:
        """The distinct numbers, and the questions of each (again for each time it is named)."""
        own: dict[str, list[int]] = {}
        for j, numbers in enumerate(self.numbers):
            for n in numbers:
                own.setdefault(n, []).append(j)
        return list(own), list(own.values())


def weighted(index: Index, questions: DataFrame, keys: list[str], question: str, as_of: str | None, fact: str | None) -> DataFrame:
    """A row a question: keys (which no two questions share), until, size (of
    bigrams), grams with weights of its date, numbers without commas, fact."""
    until = F.coalesce(F.datediff(F.col(as_of).cast("date"), F.lit("1970-01-01").cast("date")), F.lit(EVER)) if as_of else F.lit(EVER)
    text = F.coalesce(F.col(question), F.lit(""))
    rows = questions.select(F.struct(*keys).alias("_key"), until.cast("int").alias("until"), T.bigrams(text).alias("_g"), F.transform(T.forced_numbers(text), lambda n: F.replace(n, F.lit(","), F.lit(""))).alias("numbers"), (T.compact(F.col(fact)) if fact else F.lit(None).cast("string")).alias("fact"))
    code = F.shiftleft(F.ascii(F.col("_c")).cast("long"), 32).bitwiseOR(F.ascii(F.substring("_c", 2, 1)).cast("long"))
    asked = rows.select("_key", "until", F.explode("_g").alias("_c")).select("_key", "until", code.alias("gram"))
    idf = lambda n: (F.log(1 + n / (1 + F.col("df"))).cast("decimal(18,6)") * 1000000).cast("long").alias("weight")
    if index.dated:
        # the last count at or before each date, by one union and a window over a gram's days
        wanted = asked.select("gram", "until").union(rows.select(F.lit(ALL).cast("long"), "until")).distinct()
        counts = index.counts.join(wanted.select("gram").distinct(), "gram", "left_semi")
        seen = joins.as_of(wanted, counts, ["gram"], "until", "day", "df", "df").where("df is not null")
        n = seen.where(F.col("gram") == ALL).select("until", F.col("df").alias("n"))
        known, on = seen.join(n, "until").select("gram", "until", idf(F.col("n"))), ["gram", "until"]
    else:
        all_ = index.counts.where(F.col("gram") == ALL).first()
        known, on = index.counts.select("gram", idf(F.lit(all_["df"] if all_ else 0))), ["gram"]
    own = asked.join(known, on).groupBy(F.col("_key").alias("_own")).agg(F.collect_list(F.struct("gram", "weight")).alias("grams"))
    return rows.join(own, F.col("_key").eqNullSafe(F.col("_own")), "left").select("_key", "until", F.size("_g").alias("size"), "grams", "numbers", "fact")


def stripe(rows: list) -> Stripe:
    gram = [np.array([g["gram"] for g in r["grams"] or ()], np.int64) for r in rows]
    all_, place = np.unique(np.concatenate([np.zeros(0, np.int64), *gram]), return_inverse=True)
    weight = np.zeros((len(all_), len(rows)))
    weight[place, np.repeat(np.arange(len(rows)), [len(g) for g in gram])] = [g["weight"] for r in rows for g in r["grams"] or ()]
    return Stripe(all_, weight, np.maximum(np.sqrt([r["size"] for r in rows]), 1.0), np.array([r["until"] for r in rows], np.int32), [list(r["numbers"]) for r in rows], [r["fact"] for r in rows])


def asked(index: Index, questions: DataFrame, keys: list[str], question: str, as_of: str | None = None, fact: str | None = None) -> Iterator[tuple[list, list[Stripe]]]:
    """Questions in blocks of bounded number: their keys, and stripes of them."""
    rows = weighted(index, questions, keys, question, as_of, fact).toLocalIterator()
    while some := list(islice(rows, QUESTIONS)):
        yield [tuple(r["_key"]) for r in some], [stripe(some[i : i + STRIPE]) for i in range(0, len(some), STRIPE)]


class Reader:
    """Scores the blocks of one task. Counts what it passes over."""

    def __init__(self, stripes: list[Stripe], bonus: bool):
        self.stripes, self.bonus = stripes, bonus
        self.gram = np.unique(np.concatenate([np.zeros(0, np.int64), *[s.gram for s in stripes]]))
        self.own = []  # of each stripe, the place of each bigram of all in its own
        for s in stripes:
            at = np.full(len(self.gram), -1, np.int32)
            at[np.searchsorted(self.gram, s.gram)] = np.arange(len(s.gram))
            self.own.append(at)
        high, low = self.gram >> 32, self.gram & 0xFFFFFFFF
        named = np.unique(np.append(high, low))
        self.names, self.name = len(named) + 1, np.zeros(int(named.max(initial=0)) + 2, np.int64)  # 0: in no question
        self.name[named] = np.arange(1, self.names)
        self.table = np.full(self.names**2, -1, np.int32) if self.names <= NAMES else None
        if self.table is not None:
            self.table[self.name[high] * self.names + self.name[low]] = np.arange(len(self.gram))
        self.pairs = []
        for s in stripes:
            numbers, owners = s.forced() if bonus else ([], [])
            bits = [digit_pairs(n) for n in numbers]
            self.pairs.append((finder(numbers), owners, np.array([(b & LOW, b >> HALF) for b in bits], np.int64).reshape(-1, 2)))

    def places(self, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of each known bigram of the given sets, looked up once for all stripes."""
        row, flat = np.repeat(np.arange(len(own)), [len(c) for c in own]), np.concatenate([np.zeros(0, np.int64), *own])
        if not len(self.gram):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.gram, flat), len(self.gram) - 1)
        known = self.gram[at] == flat
        return row[known], at[known]

    def seen(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the known bigrams of some texts, looked up once for all
        stripes; a text that has one twice may give it twice."""
        row, c = characters(texts)
        if self.table is not None:
            name = self.name[np.minimum(c, len(self.name) - 1)]
            at = self.table[name[:-1] * self.names + name[1:]]
            known = at >= 0
        else:
            flat = (c[:-1] << 32) | c[1:]
            at = np.minimum(np.searchsorted(self.gram, flat), len(self.gram) - 1)
            known = self.gram[at] == flat
        known &= row[:-1] == row[1:]
        row, at = row[:-1][known], at[known].astype(np.int64)
        if len(self.gram) > DENSE:
            row, at = np.divmod(np.unique(row * len(self.gram) + at), len(self.gram))
        return row, at

    def hits(self, k: int, rows: int, found: tuple[np.ndarray, np.ndarray], columns=slice(None)) -> np.ndarray:
        place = self.own[k][found[1]]
        known = place >= 0
        return self.stripes[k].hits(rows, found[0][known], place[known])[:, columns]

    def bounds(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """What each question may score at most in each block; below any score if it sees none of it."""
        grams = batch.column("grams")
        own = np.split(grams.flatten().to_numpy(), np.cumsum(grams.value_lengths().to_numpy())[:-1]) if batch.num_rows else []
        days = batch.column("day").to_numpy()
        digits = np.stack([batch.column("digits_lo").to_numpy(), batch.column("digits_hi").to_numpy()], 1)
        out, found = [], self.places(own)
        for n, (s, (_, owners, bits)) in enumerate(zip(self.stripes, self.pairs)):
            extra = np.zeros((batch.num_rows, len(s.root)))
            for b, of in zip(bits, owners):
                np.add.at(extra, (slice(None), of), ((digits & b) == b).all(1)[:, None])
            most = s.score(self.hits(n, batch.num_rows, found), extra)
            most[days[:, None] > s.until[None, :]] = -1
            out.append(most)
        return out

    def exact(self, k: int, grams: tuple[np.ndarray, np.ndarray], texts: list[str], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, extra) of a block's chunks for some questions of stripe k; grams: their places."""
        s, (find, owners, _) = self.stripes[k], self.pairs[k]
        extra = np.zeros((len(texts), len(s.root)))
        if owners:
            for row, t in enumerate(texts):
                for i in find(t.replace(",", "")):
                    np.add.at(extra[row], owners[i], 1)
        return self.hits(k, len(texts), grams, columns), extra[:, columns]


class Best:
    """The k best chunks of each question that a task has seen."""

    def __init__(self, questions: int, k: int, bar: np.ndarray):
        self.k, self.bar = k, bar
        self.scores = np.full((questions, k), -np.inf)
        self.rows: list[tuple] = []  # question, score, sum, extra, ids

    def add(self, columns: np.ndarray, score: np.ndarray, sums: np.ndarray, extra: np.ndarray, ids: list[tuple]) -> None:
        row, at = np.nonzero(score >= self.bar[columns][None, :] - CLOSE)
        self.rows += [(int(columns[j]), score[i, j], int(sums[i, j]), int(extra[i, j]), ids[i]) for i, j in zip(row, at)]
        both = np.concatenate((self.scores[columns], score.T), 1)
        self.scores[columns] = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
        self.bar[columns] = np.maximum(self.bar[columns], self.scores[columns].min(1))
        if len(self.rows) > 64 * self.k * max(len(self.bar), 1):
            self.cut()

    def cut(self) -> None:
        """Keeps what may be among the k best; of equal scores the later ids."""
        self.rows = [r for r in self.rows if r[1] >= self.bar[r[0]] - CLOSE]
        self.rows.sort(key=lambda r: (r[0], r[1], r[4]), reverse=True)
        out, n = [], 0
        for i, r in enumerate(self.rows):
            n = n + 1 if i and self.rows[i - 1][0] == r[0] else 1
            if n <= self.k or r[1] >= out[-1][1] - CLOSE and out[-1][0] == r[0]:
                out.append(r)
        self.rows = out


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of AT_ONCE rows: matrices of blocks by bigrams and by
    questions are as tall as a part, and a batch has thousands of blocks."""
    return (batch.slice(at, AT_ONCE) for batch in batches for at in range(0, batch.num_rows, AT_ONCE))


def _ids(batch: pa.RecordBatch, ids: list[str], at: int) -> list[tuple]:
    return list(zip(*[batch.column(c)[at].as_py() for c in ids]))


def _ordered(v: np.ndarray) -> np.ndarray:
    return np.argsort(-v, kind="stable")


def _results(index: Index, rows: DataFrame, keys: list, questions: DataFrame, names: list[str], columns: list) -> DataFrame:
    """Results by number of question, with the questions' keys."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "_q int, " + ", ".join(f"`{c}` {questions.schema[c].dataType.simpleString()}" for c in names))
    return rows.join(F.broadcast(named), "_q").select(*names, *columns)  # QUESTIONS rows at most


def _score():
    return F.round(F.col("_sum") / 1e6 / F.col("_root"), 9) + BONUS * F.col("_extra")


def seeds(index: Index, shared, per_question: int) -> DataFrame:
    """Blocks with the best bounds of each question, from the bigrams alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, bonus = shared.value
        reader, best = Reader(stripes, bonus), {}
        for batch in parts(batches):
            block, lo = batch.column("block").to_numpy(), 0
            for most in reader.bounds(batch):
                for j in range(most.shape[1]):
                    top = _ordered(most[:, j])[:per_question]
                    best[lo + j] = sorted([*best.get(lo + j, ()), *((float(most[i, j]), int(block[i])) for i in top if most[i, j] > 0)], reverse=True)[:per_question]
                lo += most.shape[1]
        rows = [(q, *x) for q, own in best.items() for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], ["_q", "bound", "block"])

    found = index.blocks.select("block", "day", "grams", "digits_lo", "digits_hi").mapInArrow(run, "_q int, bound double, block long")
    return joins.top(found, per_question, ["_q"], F.col("bound").desc(), "block").select("block").distinct()


def _pass(index: Index, shared, k: int, blocks: DataFrame | None = None, counters=None) -> DataFrame:
    """(_q, ids, _sum, _root, _extra, day) of the k best chunks of each question and task."""
    ids, kinds = index.ids, {c: to_arrow_type(t) for c, t in index.kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, bonus = shared.value
        reader = Reader(stripes, bonus)
        best = [Best(len(s.root), k, np.array(s.bar) if s.bar is not None else np.full(len(s.root), -np.inf)) for s in stripes]
        looked = skipped = 0
        for batch in parts(batches):
            bounds = reader.bounds(batch)
            day = batch.column("day").to_numpy()
            for at in _ordered(np.max([m.max(1) for m in bounds], axis=0)) if batch.num_rows else ():
                grams = texts = names = None
                for n, (most, own) in enumerate(zip(bounds, best)):
                    columns = np.flatnonzero((most[at] >= own.bar - CLOSE) & (most[at] >= 0))
                    looked, skipped = looked + len(columns), skipped + most.shape[1] - len(columns)
                    if not len(columns):
                        continue
                    if grams is None:
                        texts = batch.column("texts")[at].as_py()
                        grams, names = reader.seen(texts), [(*x, int(day[at])) for x in _ids(batch, ids, at)]
                    sums, extra = reader.exact(n, grams, texts, columns)
                    own.add(columns, stripes[n].score(sums, extra, columns), sums, extra, names)
        if counters is not None:
            counters[0].add(looked)
            counters[1].add(skipped)
        rows, lo = [], 0
        for s, own in zip(stripes, best):
            own.cut()
            rows += [(lo + q, *x, total, float(s.root[q]), more) for q, _, total, more, x in own.rows]
            lo += len(s.root)
        types = [pa.int32(), *kinds.values(), pa.int32(), pa.int64(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["_q", *ids, "_day", "_sum", "_root", "_extra"])

    schema = "_q int, " + ", ".join(f"`{c}` {t.simpleString()}" for c, t in index.kinds.items()) + ", _day int, _sum long, _root double, _extra int"
    source = index.blocks if blocks is None else index.blocks.join(F.broadcast(blocks), "block", "left_semi")  # QUESTIONS * SEEDS rows at most
    return source.select(*index.blocks.columns).mapInArrow(run, schema)


def _with_bars(index: Index, stripes: list[Stripe], bonus: bool, k: int) -> None:
    """Sets each question's bar: its k-th best score within the seed blocks."""
    context = index.blocks.sparkSession.sparkContext
    shared = context.broadcast((stripes, bonus))
    found = _pass(index, shared, k, seeds(index, shared, SEEDS)).withColumn("score", _score())
    bars = {r["_q"]: r["bar"] for r in joins.top(found, k, ["_q"], F.col("score").desc()).groupBy("_q").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
    lo = 0
    for s in stripes:
        s.bar = np.array([bars.get(lo + j, -np.inf) for j in range(len(s.root))])
        lo += len(s.root)


def search(index: Index, questions: DataFrame, keys: list[str], question: str, k: int, as_of: str | None = None, bonus: bool = True, counters=None) -> DataFrame:
    """(keys, ids, announced, score, rank) of the k best chunks of each question
    among those announced by its date; of equal scores the later chunk, by ids,
    is better. Scores are as in ``retrieval``, with the weights of the date.
    counters: two accumulators, pairs of question and block that were looked at
    and that were passed over."""
    out = []
    for names, stripes in asked(index, questions, keys, question, as_of):
        _with_bars(index, stripes, bonus, k)
        shared = index.blocks.sparkSession.sparkContext.broadcast((stripes, bonus))
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day")).alias("announced")
        found = _pass(index, shared, k, None, counters).withColumn("score", _score())
        ranked = joins.top(found, k, ["_q"], F.col("score").desc(), *[F.col(c).desc() for c in index.ids])
        out.append(_results(index, ranked, names, questions, keys, [*index.ids, day, "score", "rank"]))
    if out:
        return joins.union(out)
    columns = [f"`{c}` {(questions.schema[c].dataType if c in keys else index.kinds[c]).simpleString()}" for c in (*keys, *index.ids)]
    return questions.sparkSession.createDataFrame([], ", ".join(columns) + ", announced date, score double, rank int")


def _owners(index: Index, shared) -> DataFrame:
    """(_q, owners, best): of each task how many chunks hold a question's fact,
    and the best of them as (sum, root, extra, ids)."""
    ids, kinds = index.ids, {c: to_arrow_type(t) for c, t in index.kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, bonus = shared.value
        reader = Reader(stripes, bonus)
        wanted: dict[str, list[tuple[int, int]]] = {}
        for n, s in enumerate(stripes):
            for j, f in enumerate(s.facts):
                if f:
                    wanted.setdefault(f, []).append((n, j))
        find, places, best = finder(list(wanted)), list(wanted.values()), {}
        for batch in parts(batches):
            day = batch.column("day").to_numpy()
            for at in range(batch.num_rows):
                texts = batch.column("texts")[at].as_py()
                held: dict[int, list[tuple[int, int]]] = {}
                for row, t in enumerate(texts):
                    for i in find(BLANKS.sub("", t).replace(",", "").replace("，", "")):
                        for n, j in places[i]:
                            if day[at] <= stripes[n].until[j]:
                                held.setdefault(n, []).append((row, j))
                if not held:
                    continue
                grams, names = reader.seen(texts), _ids(batch, ids, at)
                for n, pairs in held.items():
                    columns = np.unique([j for _, j in pairs])
                    sums, extra = reader.exact(n, grams, texts, columns)
                    score = stripes[n].score(sums, extra, columns)
                    for row, j in pairs:
                        c = int(np.searchsorted(columns, j))
                        count, top = best.get((n, j), (0, None))
                        own = (score[row, c], names[row], int(sums[row, c]), int(extra[row, c]))
                        best[n, j] = (count + 1, own if top is None or own[:2] > top[:2] else top)
        lo = np.cumsum([0, *[len(s.root) for s in stripes]])
        rows = [(int(lo[n] + j), count, *top[1], top[2], float(stripes[n].root[j]), top[3]) for (n, j), (count, top) in best.items()]
        types = [pa.int32(), pa.int64(), *kinds.values(), pa.int64(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["_q", "owners", *ids, "_sum", "_root", "_extra"])

    schema = "_q int, owners long, " + ", ".join(f"`{c}` {t.simpleString()}" for c, t in index.kinds.items()) + ", _sum long, _root double, _extra int"
    found = index.blocks.mapInArrow(run, schema).withColumn("score", _score())
    return found.groupBy("_q").agg(F.sum("owners").alias("owners"), F.max(F.struct("score", *ids)).alias("best"))


def _no_worse(index: Index, shared, bars) -> DataFrame:
    """(_q, n): chunks that are no worse than the question's bar, a (score, ids)."""
    ids = index.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, bonus = shared.value
        reader, total = Reader(stripes, bonus), np.zeros(sum(len(s.root) for s in stripes), np.int64)
        least = np.array([np.inf if b is None else round(b[0], 9) for b in bars.value])
        for batch in parts(batches):
            lo, bounds = 0, reader.bounds(batch)
            for n, most in enumerate(bounds):
                own = least[lo : lo + most.shape[1]]
                for at in range(batch.num_rows):
                    columns = np.flatnonzero((most[at] >= own - CLOSE) & (most[at] >= 0))
                    if not len(columns):
                        continue
                    texts = batch.column("texts")[at].as_py()
                    grams = reader.seen(texts)
                    sums, extra = reader.exact(n, grams, texts, columns)
                    score = np.round(stripes[n].score(sums, extra, columns), 9)
                    total[lo + columns] += (score > own[columns]).sum(0)
                    row, c = np.nonzero(score == own[columns])
                    if len(row):
                        names = _ids(batch, ids, at)
                        for i, j in zip(row, c):
                            total[lo + columns[j]] += names[i] >= tuple(bars.value[lo + columns[j]][1:])
                lo += most.shape[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["_q", "n"])

    return index.blocks.mapInArrow(run, "_q int, n long").groupBy("_q").agg(F.sum("n").alias("best_rank"))


def fact_ranks(index: Index, questions: DataFrame, keys: list[str], question: str, fact: str, top: int = 6, as_of: str | None = None, bonus: bool = True) -> DataFrame:
    """(keys, owners, best_rank, in_top): how many chunks hold a question's fact,
    commas and white space aside, the best rank of one among all chunks, and how
    many are in the top. A fact that no chunk holds has no rank, nor has an empty
    one. All facts are found in one pass; ranks are counts of chunks that are no
    worse, from blocks that may hold one."""
    context, out = index.blocks.sparkSession.sparkContext, []
    for names, stripes in asked(index, questions, keys, question, as_of, fact):
        held = {r["_q"]: (r["owners"], tuple(r["best"])) for r in _owners(index, context.broadcast((stripes, bonus))).collect()}
        bars = context.broadcast([held[i][1] if i in held else None for i in range(len(names))])
        ranks = _no_worse(index, context.broadcast((stripes, bonus)), bars)
        facts = [f for s in stripes for f in s.facts]
        _with_bars(index, stripes, bonus, top)
        found = joins.top(_pass(index, context.broadcast((stripes, bonus)), top).withColumn("score", _score()), top, ["_q"], F.col("score").desc(), *[F.col(c).desc() for c in index.ids])
        text = index.blocks.select(F.explode(F.arrays_zip(*index.ids, "texts")).alias("c")).select(*[F.col(f"c.{c}") for c in index.ids], F.col("c.texts").alias("_text"))
        asked_ = index.blocks.sparkSession.createDataFrame([(i, held.get(i, (0,))[0], facts[i]) for i in range(len(names))], "_q int, owners long, _fact string")
        # QUESTIONS * top rows at most meet the texts, which stay where they are; only theirs are made compact
        shown = text.join(F.broadcast(found.join(F.broadcast(asked_), "_q").where("_fact <> ''")), index.ids)
        holding = shown.where(F.contains(T.compact(F.col("_text")), F.col("_fact"))).groupBy("_q").agg(F.count("*").alias("in_top"))
        rows = asked_.join(ranks, "_q", "left").join(holding, "_q", "left").na.fill(0, ["in_top"])
        out.append(_results(index, rows, names, questions, keys, ["owners", "best_rank", "in_top"]))
    return joins.union(out)
