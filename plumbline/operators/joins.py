"""Joins between independent accounts of the same thing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 1 << 20  # rows up to which a side is broadcast
DEALT = 1 << 19  # rows of a partition that is dealt by key


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has ``most`` rows at most; that is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(rows: DataFrame, by: list[str], most: int = DEALT) -> DataFrame:
    """rows dealt out by key to as many partitions as keep one near ``most``
    rows, which are counted: what is then grouped or sorted by these keys takes
    no more memory in a task the more rows there are, as it would with a fixed
    number of partitions or where maps group what they read. Few rows stay."""
    n = -(-rows.count() // most)
    return rows.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by) if n > 1 else rows


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join: keys, value_a, value_b, diff (both sides only), _merge."""
    left = a.select(*keys, F.col(value).alias(f"{value}_a"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.col(value).alias(f"{value}_b"), F.lit(True).alias("_in_b"))
    side = F.when(F.col("_in_a") & F.col("_in_b"), "both").when(F.col("_in_a"), "left_only").otherwise("right_only")
    both = left.join(right, keys, "full_outer").withColumn("_merge", side).drop("_in_a", "_in_b")
    return both.withColumn("diff", F.when(F.col("_merge") == "both", F.abs(F.col(f"{value}_a") - F.col(f"{value}_b"))))


def reconciliation(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Counts of each side, the largest difference and those beyond the tolerance."""
    return rows.agg(*[F.count_if(F.col("_merge") == s).alias(s) for s in ("both", "left_only", "right_only")], F.max("diff").alias("max_diff"), F.count_if(F.col("diff") > tolerance).alias("over"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; old ones that weren't found again stay."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_old"))
    n = new.select(*keys, F.struct(*rest).alias("_new"))
    return o.join(n, keys, "full_outer").select(*keys, F.coalesce("_new", "_old").alias("_r")).select(*keys, "_r.*")


def manifest(old: DataFrame, found: DataFrame, on_disk: DataFrame, failed: DataFrame, key: str, file: str) -> DataFrame:
    """The next manifest, one row a key: what was found now; an old entry that
    wasn't found again as long as its file is still there; and nothing for keys
    whose listing or download failed, which are left for the next run."""
    kept = old.join(found.select(key), key, "left_anti").join(on_disk.select(file), file, "left_semi")
    return union([found, kept.select(*found.columns)]).join(failed.select(key), key, "left_anti")


def last_known(df: DataFrame, value: str, order: str, by: list[str], into: str) -> DataFrame:
    """The last value that isn't NULL, at or before each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def next_known(df: DataFrame, value: str, order: str, by: list[str], into: str) -> DataFrame:
    """The next value that isn't NULL, at or after each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(into, F.first(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, into: str) -> DataFrame:
    """Backward as-of join by union and last value: one shuffle on the keys,
    whatever the gaps between times. Of equal times, right rows come first."""
    rest = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).withColumn(into, F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select(*by, "_row.*", into)


def lookback(df: DataFrame, value: str, order: str, by: list[str], steps: int, into: str) -> DataFrame:
    """The value of this row or, if NULL, of up to ``steps`` rows before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(into, F.coalesce(F.col(value), *[F.lag(value, k).over(w) for k in range(1, steps + 1)]))


def enriched(facts: DataFrame, facts_about: DataFrame, keys: list[str]) -> DataFrame:
    """facts with what a manifest (one row a key) says of each key; NULL where it says nothing."""
    return facts.join(small(facts_about), keys, "left")


def pairwise(rows: DataFrame, by: list[str], prefer: Column, score: Column) -> DataFrame:
    """Of competing versions of a thing the one with the best score; the preferred one wins ties."""
    w = Window.partitionBy(*by).orderBy(score.desc(), prefer.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def largest(rows: DataFrame, by: list[str], size: Column, least: int, *tie) -> DataFrame:
    """The largest row of each group with ``least`` at least; the first wins ties."""
    w = Window.partitionBy(*by).orderBy(size.desc(), *tie)
    return rows.where(size >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def smallest(rows: DataFrame, size: str, tie: str) -> DataFrame:
    """The row with the smallest size, as one row."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.agg(F.min_by(row, F.struct(F.col(size), F.col(tie))).alias("_r")).where("_r is not null").select("_r.*")


def by_dictionary(rows: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their concept: equi-join on keys; of an alias that is claimed
    twice the later definition (ord) counts."""
    own = aliases.groupBy(*keys).agg(F.max_by("concept", "ord").alias("concept"))
    return rows.join(own, keys, "left")


def first_rows(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def top(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def equidistant(df: DataFrame, n: int, by: str) -> DataFrame:
    """n rows at equal distances of rank, floor(i * rows / n), from two-level ranks."""
    ranked = ranked_globally(df, by)
    total = df.count()
    picked = sorted({i * total // n for i in range(n)}) if total else []
    return ranked.where(F.col("rank").isin(picked)) if picked else ranked.limit(0)


def ranked_globally(df: DataFrame, by: str) -> DataFrame:
    """rank from 0 over the whole table without one task that sorts it: range
    partitions, their sizes, and ranks within."""
    # a number of its own keeps the partitions as they are: both readers see one exchange
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, by).withColumn("_p", F.spark_partition_id())
    sizes = dealt.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1
    return dealt.withColumn("_i", inside).join(F.broadcast(offsets), "_p").withColumn("rank", (F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_i", "_before")


def product(dimensions: list[DataFrame], facts: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of small dimensions, with facts where there are any."""
    return reduce(lambda a, b: a.crossJoin(small(b)), dimensions).join(facts, keys, "left")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def status_ladder(*steps: tuple[Column, str, str], otherwise: tuple[str, str] = ("✓", "ok")) -> tuple[Column, Column]:
    """Ordered case: the first condition that holds gives the status and why."""
    status = reduce(lambda acc, s: acc.when(s[0], s[1]), steps[1:], F.when(steps[0][0], steps[0][1])).otherwise(otherwise[0])
    why = reduce(lambda acc, s: acc.when(s[0], s[2]), steps[1:], F.when(steps[0][0], steps[0][2])).otherwise(otherwise[1])
    return status, why
