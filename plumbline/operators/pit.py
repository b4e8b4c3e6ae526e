"""Point in time: calendars, windows between a period's end and its publication, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import small


NO_CALENDAR = "the calendar has no day"  # an error of the run itself, as without days every window would be empty


def calendar(df: DataFrame, date: str) -> DataFrame:
    """Observed days only, not business days."""
    return df.select(F.col(date).cast("date").alias("day")).where("day is not null").distinct()


def ranked_calendar(days: DataFrame) -> DataFrame:
    """(day, n): n days up to and including this one."""
    return days.select("day", F.row_number().over(Window.orderBy("day")).cast("long").alias("n"))


def windows(facts: DataFrame, days: DataFrame, period: str, announced: str) -> DataFrame:
    """facts with calendar days and trading days in (period, announced].

    Each end looks up the rank of the last day at or before it; the number of
    days between is the difference of ranks. The calendar is a few rows a
    year, so a map of ranks travels with it, and no range join is planned."""
    every = F.sort_array(F.collect_list("day"))
    ranks = ranked_calendar(days).agg(every.alias("_days")).select(F.when(F.size("_days") > 0, F.col("_days")).otherwise(F.raise_error(F.lit(NO_CALENDAR))).alias("_days"))

    def rank(c: str):
        d, lo = F.col("_days"), F.lit(0)
        # binary search by halving: 2**24 days are far beyond any calendar
        step = F.array(*[F.lit(1 << k) for k in range(23, -1, -1)])
        return F.aggregate(step, lo, lambda at, s: F.when((at + s <= F.size(d)) & (F.get(d, at + s - 1) <= F.col(c).cast("date")), at + s).otherwise(at))

    out = facts.crossJoin(F.broadcast(ranks)).withColumn("cal_days", F.date_diff(F.col(announced).cast("date"), F.col(period).cast("date")))
    return out.withColumn("trade_days", F.greatest(rank(announced) - rank(period), F.lit(0)).cast("long")).drop("_days")


def covered_days(facts: DataFrame, days: DataFrame, period: str, announced: str) -> DataFrame:
    """Distinct days in the union of all windows. Windows are first merged into
    islands, so each day joins one island at most."""
    w = Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    # of windows that start on one day the longest holds all others, so the rows below are as few as days
    ends = facts.select(F.col(period).cast("date").alias("lo"), F.col(announced).cast("date").alias("hi")).where("lo < hi").groupBy("lo").agg(F.max("hi").alias("hi"))
    marked = ends.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(w), F.lit("0001-01-01").cast("date"))).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(Window.orderBy("lo", "hi"))).groupBy("island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return days.join(small(island), (F.col("day") > F.col("lo")) & (F.col("day") <= F.col("hi")), "left_semi")


def window_statistics(found: DataFrame, covered: DataFrame, days: DataFrame) -> DataFrame:
    """Mean and sum of trading days, size of the union, overlap and share of the calendar."""
    sums = found.agg(F.count("*").alias("windows"), F.avg("trade_days").alias("mean_days"), F.sum("trade_days").alias("sum_days"))
    whole = days.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.raise_error(F.lit(NO_CALENDAR)).cast("long")).alias("calendar_days"))
    out = sums.crossJoin(covered.agg(F.count("*").alias("union_days"))).crossJoin(whole)
    return out.withColumns({"overlap_days": F.col("sum_days") - F.col("union_days"), "share": F.col("union_days") / F.col("calendar_days")})


def visible(facts: DataFrame, as_of: DataFrame, announced: str) -> DataFrame:
    """Each as-of date with the facts announced by then (inclusive): a row for
    each fact and date that sees it. Do this before anything is counted; where
    counts are all that's wanted, take ``visible_counts``."""
    return facts.join(small(as_of), F.col(announced) <= F.col("as_of"))


def visible_counts(facts: DataFrame, as_of: DataFrame, announced: str) -> DataFrame:
    """(as_of, n, latest): facts are counted by day first, so that what meets
    the dates is no longer than a calendar."""
    daily = facts.groupBy(F.col(announced).alias("_day")).agg(F.count("*").alias("_n"))
    seen = daily.join(small(as_of), F.col("_day") <= F.col("as_of"))
    return seen.groupBy("as_of").agg(F.sum("_n").alias("n"), F.max("_day").alias("latest"))


def leaks(claims: DataFrame, facts: DataFrame, key: str, announced: str) -> DataFrame:
    """Claims (key, as_of) whose fact exists, but only after the as-of date."""
    first = facts.groupBy(key).agg(F.min(announced).alias("first_seen"))
    return claims.join(first, key).where(F.col("first_seen") > F.col("as_of"))

