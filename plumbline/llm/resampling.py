"""Importance resampling towards a target distribution, in DataFrame functions only.

The features of a text are its runs of one to three words, each in one of
``BUCKETS`` buckets by the crc32 of its bytes. How much more often a bucket
occurs in the target than in the corpus is the bucket's gain, in thousandths of
a natural logarithm; a document weighs the sum of the gains of its features. A
Gumbel variate made from the document's id is added, so that drawing the
highest scores samples without replacement in proportion to exp(weight).

Only counts by bucket are broadcast, ``BUCKETS`` rows whatever the corpus. Texts
are read once for the corpus's counts and once for the weights; what is shuffled
is a row a bucket and task, a row a document, and the sort, whose ranks come
from places within its partitions and the sizes of the partitions before.

Null and empty texts have no features, weigh 0 and aren't drawn. A null id
counts as the empty string in the variate and comes last among ties. Rows with
equal id and text are summed as one and given back as many times, with ranks in
a row. Very long texts are exploded like others, a word at a time. Other columns
are neither read nor needed; ``drawn`` keeps them, whatever their names. With
an empty corpus there is no row; with an empty target all gains come from the
corpus alone.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import scratch
from plumbline.llm.exprs import unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
BUCKETS = 10_000
LONGEST = 3  # words of a feature at most
MIN_WORDS, PER_CENT = 20, 5  # words from which a document can be drawn, and how many of these are


def words(text: Column) -> Column:
    """Words of a text, A-Z in small letters; none for null."""
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(small, F.lit("")), SEPARATORS, -1), "")


def bucket(feature: Column) -> Column:
    return F.crc32(feature.cast("binary")) % BUCKETS


def exploded(df: DataFrame, text_col: str, *keys: Column) -> DataFrame:
    """A row for each feature: keys, at (the word it starts with; null where a
    text has no words), more (words after it), bucket. A place keeps its row for
    ``more`` 0 even where there is no feature, so that no document goes missing."""
    placed = df.select(*keys, words(F.col(text_col)).alias("_words")).select("*", F.posexplode_outer("_words").alias("at", "_w0"))
    runs = [F.col("_w0")]
    for k in range(1, LONGEST):
        runs.append(F.concat(runs[-1], F.lit(" "), F.get("_words", F.col("at") + k)))
    out = placed.select(*[c for c in placed.columns if not c.startswith("_w")], F.posexplode(F.array(*map(bucket, runs))).alias("more", "bucket"))
    return out.where("more = 0 or bucket is not null")


def bucket_counts(df: DataFrame, text_col: str) -> DataFrame:
    """How many features of all texts lie in each bucket that has any."""
    counts = exploded(df, text_col).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    return scratch.staged(counts, "bucket-counts")


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text") -> DataFrame:
    """bucket, gain: a row for each of the ``BUCKETS`` buckets."""
    own, wanted = bucket_counts(docs, text_col), bucket_counts(target, target_col)
    sums = [counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)) for counts, name in ((own, "_all"), (wanted, "_wanted"))]
    rows = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    rows = rows.join(F.broadcast(own.withColumnRenamed("n", "_s")), "bucket", "left").join(F.broadcast(wanted.withColumnRenamed("n", "_t")), "bucket", "left")
    s, t, all_s, all_t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("_s", "_t", "_all", "_wanted"))
    gain = F.floor(1000 * F.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS))))
    return rows.crossJoin(F.broadcast(sums[0])).crossJoin(F.broadcast(sums[1])).select("bucket", gain.cast("long").alias("gain"))  # one row each


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on seed and key alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """A row for each row of docs: id, text_hash, copy (of rows with equal id and
    text, from 1), n_words, n_features, weight, score."""
    table = F.broadcast(scratch.staged(gains(docs, target, text_col), "gains"))
    features = exploded(docs, text_col, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    first = F.col("more") == 0
    sums = features.join(table, "bucket", "left").groupBy("id", "text_hash").agg(
        F.count_if(first & (F.coalesce("at", F.lit(0)) == 0)).alias("copies"), F.count_if(first & F.col("bucket").isNotNull()).alias("n_words"),
        F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"),
    )
    each = [F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")]
    rows = sums.select("id", "text_hash", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), *each)
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))


def ranked(rows: DataFrame, candidate: Column, *order: Column) -> DataFrame:
    """rows with rank, from 1 in the given order among candidates; null for
    others. The order must be total but for equal rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [(~candidate).asc(), *order]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = scratch.staged(dealt, "sorted")
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).count()  # a row for each partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    rank = F.when(candidate, F.col("_before") + inside + 1).cast("long")
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn("rank", rank).drop("_part", "_before", "_place")


def sampled(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 42, min_words: int = MIN_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """Like ``weighted``, with rank: of the N rows of min_words words or more,
    the floor(per_cent * N / 100) with the highest scores have ranks from 1."""
    rows = scratch.staged(weighted(docs, target, text_col, id_col, seed), "weights")
    candidate = F.col("n_words") >= min_words
    most = rows.where(candidate).count() * per_cent // 100
    out = ranked(rows, candidate, F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("text_hash"), F.col("copy"))
    return out.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))


def drawn(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs, all columns as they are."""
    chosen = sampled(docs, target, text_col, id_col, **options).where("rank is not null").groupBy("id", "text_hash").agg(F.count("*").alias("_drawn"))
    hashed, number = unused(docs, "_hash"), unused(docs, "_number")
    rows, picked = docs.withColumn(hashed, F.xxhash64(text_col)).alias("rows"), chosen.alias("picked")
    same = (F.col(f"rows.{hashed}") == F.col("picked.text_hash")) & F.col(f"rows.`{id_col}`").eqNullSafe(F.col("picked.id"))
    met = rows.join(picked, same).select(F.struct(*[F.col(f"rows.`{c}`") for c in docs.columns]).alias("_row"), F.col(f"rows.{hashed}").alias(hashed), F.col("picked.id").alias("_id"), "picked._drawn")
    copies = Window.partitionBy("_id", hashed).orderBy(hashed)
    return met.withColumn(number, F.row_number().over(copies)).where(F.col(number) <= F.col("_drawn")).select("_row.*")
