"""Price-like series: returns, momentum, adjustment gaps, sign flips, baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change(value: str, rows: int, by: str, order: str) -> Column:
    """value over the value that many rows before, less one."""
    return F.col(value) / F.lag(value, rows).over(Window.partitionBy(by).orderBy(order)) - 1


def flip(a: Column, b: Column) -> Column:
    """Signs differ where both are known; zero counts as not positive."""
    return F.when(a.isNotNull() & b.isNotNull(), (a > 0) != (b > 0))


def adjusted_frame(raw: DataFrame, adjusted: DataFrame, lag: int = 20, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Inner join of a raw and an adjusted series (symbol, date, close) with
    daily returns, momentum over ``lag`` rows, the gap of returns, and flips."""
    both = raw.select(symbol, date, F.col("close").alias("raw")).join(adjusted.select(symbol, date, F.col("close").alias("adj")), [symbol, date])
    out = both.select("*", *[change(c, n, symbol, date).alias(f"{p}_{c}") for c in ("raw", "adj") for p, n in (("r", 1), ("mom", lag))])
    return out.withColumns({"fake": F.col("r_raw") - F.col("r_adj"), "flip": flip(F.col("mom_raw"), F.col("mom_adj"))})


def three_way(raw: DataFrame, forward: DataFrame, backward: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Days that a raw and two adjusted series have in common, with each one's
    daily return and the gap of the adjusted ones', which should be none. The
    three series are one table that is grouped once, instead of two joins."""
    named = [df.select(symbol, date, F.lit(k).alias("_k"), "close") for k, df in (("raw", raw), ("fwd", forward), ("bwd", backward))]
    long = named[0].unionByName(named[1]).unionByName(named[2])
    wide = long.groupBy(symbol, date).agg(*[F.max(F.when(F.col("_k") == k, F.col("close"))).alias(k) for k in ("raw", "fwd", "bwd")]).dropna()
    out = wide.select("*", *[change(k, 1, symbol, date).alias(f"r_{k}") for k in ("raw", "fwd", "bwd")])
    return out.withColumn("gap", F.abs(F.col("r_fwd") - F.col("r_bwd")))


def metrics(frame: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Per symbol: days, total returns in per cent, their gap in points, flip days, largest gap of daily returns."""

    def total(c: str) -> Column:
        return F.max_by(c, date) / F.min_by(c, date) - 1

    out = frame.groupBy(symbol).agg(F.count("*").alias("days"), total("raw").alias("_raw"), total("adj").alias("_adj"), F.count_if("flip").alias("q2_flip_days"), F.max(F.abs("fake")).alias("_fake"))
    return out.select(
        symbol, "days", F.round(100 * F.col("_raw"), 2).alias("ret_raw_pct"), F.round(100 * F.col("_adj"), 2).alias("ret_adj_pct"),
        F.round(F.abs(F.col("_raw") - F.col("_adj")) * 100, 3).alias("q1_ret_gap_pt"), "q2_flip_days", F.round(100 * F.col("_fake"), 3).alias("q3_max_fake_gap_pt"),
    )


def basket(rows: DataFrame) -> DataFrame:
    """Summary of metrics over all symbols that have them."""
    own = rows.dropna(subset=["q1_ret_gap_pt"])
    return own.agg(
        F.count("*").alias("symbols"), F.count_if(F.col("q2_flip_days") > 0).alias("with_flips"), F.sum("q2_flip_days").alias("flip_days"), F.max("q2_flip_days").alias("most_flips"),
        F.count_if(F.col("q1_ret_gap_pt") > 1).alias("gap_over_1"), F.count_if(F.col("q1_ret_gap_pt") > 3).alias("gap_over_3"), F.round(F.median("q1_ret_gap_pt"), 6).alias("gap_median"), F.round(F.avg("q1_ret_gap_pt"), 6).alias("gap_mean"), F.round(F.median("q3_max_fake_gap_pt"), 6).alias("fake_median"), F.max("q3_max_fake_gap_pt").alias("fake_max"),
    )


def invariance(frame: DataFrame, a: str, b: str) -> DataFrame:
    """The largest difference between two adjustments' returns: none is expected."""
    return frame.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("max_difference"))
