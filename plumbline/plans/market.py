"""Queries on series, reconciliation and point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import diagnosis, joins, pit, series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _accounts(spark, sf_dir):
    """Order totals as stated, and as their lines add up, in cents so that sums are exact."""
    cents = lambda c: F.round(c * 100).cast("long")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), cents(F.col("o_totalprice")).alias("cents"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(cents(F.col("l_extendedprice"))).alias("cents"))
    return a, b


ACCOUNTS = """
a AS (SELECT o_orderkey AS key, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
b AS (SELECT l_orderkey AS key, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY 1),
r AS (SELECT key, a.cents AS cents_a, b.cents AS cents_b, CASE WHEN b.key IS NULL THEN 'left_only' WHEN a.key IS NULL THEN 'right_only' ELSE 'both' END AS _merge,
  abs(a.cents - b.cents) AS diff FROM a FULL JOIN b USING (key))"""


def recon_outer(spark, sf_dir):
    return joins.reconcile(*_accounts(spark, sf_dir), ["key"], "cents")


def recon_summary(spark, sf_dir):
    return joins.reconciliation(recon_outer(spark, sf_dir), 1)


def recon_top_diffs(spark, sf_dir):
    return recon_outer(spark, sf_dir).where("diff is not null").orderBy(F.desc("diff"), "key").limit(5).select("key", "diff")


def recon_only_a(spark, sf_dir):
    a, b = _accounts(spark, sf_dir)
    return a.join(b, "key", "left_anti")


def _bars(spark, sf_dir):
    """Daily closes of each event type in thousandths, raw and adjusted by a split half-way."""
    e = table(spark, sf_dir, "events").where("value is not null")
    raw = e.groupBy(F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("date")).agg((F.floor(F.avg(F.round(F.col("value") * 1000).cast("long"))) / 1000 + 1).alias("close"))
    adjusted = raw.withColumn("close", F.col("close") * F.when(F.day("date") < 15, 0.97).otherwise(1.0))
    return raw, adjusted


BARS = """
raw AS (SELECT event_type AS symbol, ts::DATE AS date, floor(avg(round(value * 1000)::BIGINT)) / 1000 + 1 AS raw FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, raw * CASE WHEN day(date) < 15 THEN 0.97::DOUBLE ELSE 1.0::DOUBLE END AS adj FROM raw),
w AS (SELECT *, raw / lag(raw) OVER o - 1 AS r_raw, raw / lag(raw, 20) OVER o - 1 AS mom_raw, adj / lag(adj) OVER o - 1 AS r_adj, adj / lag(adj, 20) OVER o - 1 AS mom_adj
  FROM f WINDOW o AS (PARTITION BY symbol ORDER BY date)),
frame AS (SELECT *, r_raw - r_adj AS fake, CASE WHEN mom_raw IS NOT NULL AND mom_adj IS NOT NULL THEN (mom_raw > 0) <> (mom_adj > 0) END AS flip FROM w),
m AS (SELECT symbol, count(*) AS days, round(100 * (max_by(raw, date) / min_by(raw, date) - 1), 2) AS ret_raw_pct, round(100 * (max_by(adj, date) / min_by(adj, date) - 1), 2) AS ret_adj_pct,
  round(abs((max_by(raw, date) / min_by(raw, date) - 1) - (max_by(adj, date) / min_by(adj, date) - 1)) * 100, 3) AS q1_ret_gap_pt, count(*) FILTER (flip) AS q2_flip_days, round(100 * max(abs(fake)), 3) AS q3_max_fake_gap_pt
  FROM frame GROUP BY symbol)"""


def _frame(spark, sf_dir):
    return series.adjusted_frame(*_bars(spark, sf_dir))


def adjusted_returns(spark, sf_dir):
    names = ("r_raw", "mom_raw", "r_adj", "mom_adj", "fake")
    return _frame(spark, sf_dir).select("symbol", "date", *[(F.round(c, 9) + 0.0).alias(c) for c in names], "flip")  # no negative zeros


def basket_metrics(spark, sf_dir):
    return series.metrics(_frame(spark, sf_dir))


def basket_summary(spark, sf_dir):
    return series.basket(basket_metrics(spark, sf_dir))


def basket_top_gaps(spark, sf_dir):
    return basket_metrics(spark, sf_dir).orderBy(F.desc("q1_ret_gap_pt"), "symbol").limit(3).select("symbol", "q1_ret_gap_pt")


def return_invariance(spark, sf_dir):
    """Prices adjusted forwards and backwards from the split have the same returns on every day."""
    return series.invariance(_three(spark, sf_dir), "r_fwd", "r_bwd").select((F.col("max_difference") < 1e-9).alias("invariant"))


def _three(spark, sf_dir):
    raw, backward = _bars(spark, sf_dir)
    forward = raw.withColumn("close", F.col("close") * F.when(F.day("date") >= 15, 1 / 0.97).otherwise(1.0))
    return series.three_way(raw, forward, backward)


def three_series(spark, sf_dir):
    """Days of each symbol in all three series, and how far the raw return strays from the adjusted one."""
    out = _three(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("days"), F.round(F.max(F.abs(F.col("r_raw") - F.col("r_fwd"))), 9).alias("largest"))
    return out


def next_manifest(spark, sf_dir):
    """A manifest of suppliers after a run that found some, failed for some, and has lost some files."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("file"))
    old, found = s.where("key % 2 = 0").withColumn("run", F.lit(1)), s.where("key % 3 = 0").withColumn("run", F.lit(2))
    return joins.manifest(old, found, s.where("key % 5 <> 0"), s.where("key % 7 = 0"), "key", "file").select("key", "file", "run")


def largest_gaps(spark, sf_dir):
    """The five days with the largest gap of returns, unknown gaps last."""
    return diagnosis.largest_gaps(_frame(spark, sf_dir), "fake", 5, "symbol", "date").select("symbol", "date", F.round("fake", 9).alias("fake"))


def constituents(spark, sf_dir):
    """Members of an index from the first source with any: the first one is empty here."""
    from plumbline.sources.readers import constituents as members

    c = table(spark, sf_dir, "customer").select(F.lpad((F.col("c_custkey") % 500).cast("string"), 6, "0").alias("code"), F.col("c_name").alias("name"))
    fallback = spark.createDataFrame([("000001", "only if all else is empty")], "code string, name string")
    return members([c.where("code is null"), c], fallback).select("code", "name", "source")


def smallest_part(spark, sf_dir):
    """The cheapest part, as the one to look at first."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("size"))
    return joins.smallest(p, "size", "p_partkey")


def _windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    days = pit.calendar(o, "o_orderdate")
    facts = o.select(F.col("o_orderkey").alias("key"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"), F.col("o_orderdate").cast("date").alias("announced"))
    return facts, days


PIT = """
days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
facts AS (SELECT o_orderkey AS key, date_trunc('month', o_orderdate)::DATE AS period, o_orderdate::DATE AS announced FROM orders),
spans AS (SELECT period, announced, (SELECT count(*) FROM days WHERE day > period AND day <= announced) AS trade_days FROM (SELECT DISTINCT period, announced FROM facts)),
found AS (SELECT key, period, announced, announced - period AS cal_days, trade_days FROM facts JOIN spans USING (period, announced))"""


def pit_windows(spark, sf_dir):
    return pit.windows(*_windows(spark, sf_dir), "period", "announced").withColumn("cal_days", F.col("cal_days").cast("long"))


def pit_statistics(spark, sf_dir):
    facts, days = _windows(spark, sf_dir)
    found = pit.windows(facts, days, "period", "announced")
    return pit.window_statistics(found, pit.covered_days(facts, days, "period", "announced"), days)


def trading_calendar(spark, sf_dir):
    return pit.ranked_calendar(pit.calendar(table(spark, sf_dir, "orders"), "o_orderdate"))


def as_of_visible(spark, sf_dir):
    """How many orders, and of what total, each as-of date can see."""
    dates = spark.createDataFrame([(f"{y}-06-30",) for y in range(1992, 2026)], "d string").select(F.to_date("d").alias("as_of"))
    o = table(spark, sf_dir, "orders").withColumn("announced", F.col("o_orderdate").cast("date"))
    return pit.visible_counts(o, dates, "announced")


def as_of_leaks(spark, sf_dir):
    """Customers claimed at a date whose first order came later."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("announced"))
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.date_add(F.lit("1993-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")).alias("as_of"))
    return pit.leaks(claims, o, "key", "announced")


def as_of_join(spark, sf_dir):
    """For each click, its user's last purchase value so far."""
    e = table(spark, sf_dir, "events").where("value is not null and user_id is not null")
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(clicks, bought, ["user_id"], "ts", "ts", "value", "last_value").select("event_id", "user_id", "last_value")


def carried_forward(spark, sf_dir):
    """The last purchase's event id at or before each event of a user."""
    e = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return joins.last_known(e, "mark", "event_id", ["user_id"], "anchor").select("event_id", "anchor")


def attributed_forward(spark, sf_dir):
    """Turns that belong to the next assistant turn of their conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("mark", F.when(F.col("role") == "assistant", F.col("turn")))
    return joins.next_known(c, "mark", "turn", ["conv_id"], "owner").where("mark is null and owner is not null").select("conv_id", "turn", "owner")


def looked_back(spark, sf_dir):
    """A unit from this turn or up to two turns before."""
    c = table(spark, sf_dir, "conversations").withColumn("unit", F.when(F.char_length("text") % 3 == 0, F.col("turn")))
    return joins.lookback(c, "unit", "turn", ["conv_id"], 2, "unit_used").select("conv_id", "turn", "unit_used")


def upserted(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    new = s.where("key % 3 = 0").select((F.col("key") + 30).alias("key"), "name", (F.col("bal") + 1).alias("bal"))
    return joins.upsert(s, new, ["key"])


def best_source(spark, sf_dir):
    """Of each customer the order of the best priority, latest first."""
    from plumbline.sources.readers import first_source

    o = table(spark, sf_dir, "orders").withColumn("_rank", F.struct("o_orderpriority", (-F.unix_date(F.col("o_orderdate").cast("date"))).alias("d"), "o_orderkey"))
    return first_source(o, ["o_custkey"], F.col("_rank")).select("o_custkey", "o_orderkey", "o_orderpriority")


def not_yet_fetched(spark, sf_dir):
    """Customers of whom no order is in the cache of those in progress."""
    from plumbline.sources.readers import missing

    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return missing(wanted, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")), ["key"])


def equidistant_sample(spark, sf_dir):
    return joins.equidistant(table(spark, sf_dir, "part").select("p_partkey"), 50, "p_partkey").select("p_partkey", "rank")


def first_qualifying(spark, sf_dir):
    """Each supplier's first line over a price, in order of keys."""
    l = table(spark, sf_dir, "lineitem").where("l_extendedprice > 30000")
    return joins.first_rows(l, ["l_suppkey"], "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber")


QUERIES = {f.__name__: f for f in (
    recon_outer, recon_summary, recon_top_diffs, recon_only_a, adjusted_returns, basket_metrics, basket_summary, basket_top_gaps, return_invariance, three_series, next_manifest, largest_gaps, constituents, smallest_part, pit_windows, pit_statistics, trading_calendar,
    as_of_visible, as_of_leaks, as_of_join, carried_forward, attributed_forward, looked_back, upserted, best_source, not_yet_fetched, equidistant_sample, first_qualifying,
)}

ORACLES = {
    "recon_outer": f"WITH {ACCOUNTS} SELECT * FROM r",
    "recon_summary": f"WITH {ACCOUNTS} SELECT count(*) FILTER (_merge = 'both') AS both, count(*) FILTER (_merge = 'left_only') AS left_only, count(*) FILTER (_merge = 'right_only') AS right_only, max(diff) AS max_diff, count(*) FILTER (diff > 1) AS over FROM r",
    "recon_top_diffs": f"WITH {ACCOUNTS} SELECT key, diff FROM r WHERE diff IS NOT NULL ORDER BY diff DESC, key LIMIT 5",
    "recon_only_a": f"WITH {ACCOUNTS} SELECT key, cents_a AS cents FROM r WHERE _merge = 'left_only'",
    "adjusted_returns": f"WITH {BARS} SELECT symbol, date, round(r_raw, 9) + 0.0 AS r_raw, round(mom_raw, 9) + 0.0 AS mom_raw, round(r_adj, 9) + 0.0 AS r_adj, round(mom_adj, 9) + 0.0 AS mom_adj, round(fake, 9) + 0.0 AS fake, flip FROM frame",
    "basket_metrics": f"WITH {BARS} SELECT * FROM m",
    "basket_summary": f"WITH {BARS} SELECT count(*) AS symbols, count(*) FILTER (q2_flip_days > 0) AS with_flips, sum(q2_flip_days)::BIGINT AS flip_days, max(q2_flip_days) AS most_flips, count(*) FILTER (q1_ret_gap_pt > 1) AS gap_over_1, count(*) FILTER (q1_ret_gap_pt > 3) AS gap_over_3, round(median(q1_ret_gap_pt), 6) AS gap_median, round(avg(q1_ret_gap_pt), 6) AS gap_mean, round(median(q3_max_fake_gap_pt), 6) AS fake_median, max(q3_max_fake_gap_pt) AS fake_max FROM m WHERE q1_ret_gap_pt IS NOT NULL",
    "basket_top_gaps": f"WITH {BARS} SELECT symbol, q1_ret_gap_pt FROM m ORDER BY q1_ret_gap_pt DESC, symbol LIMIT 3",
    "return_invariance": f"WITH {BARS}, v AS (SELECT *, raw * CASE WHEN day(date) >= 15 THEN 1 / 0.97::DOUBLE ELSE 1 END AS fwd FROM f), d AS (SELECT fwd / lag(fwd) OVER o - adj / lag(adj) OVER o AS gap FROM v WINDOW o AS (PARTITION BY symbol ORDER BY date)) SELECT max(abs(gap)) < 1e-9 AS invariant FROM d",
    "three_series": f"WITH {BARS}, v AS (SELECT *, raw * CASE WHEN day(date) >= 15 THEN 1 / 0.97::DOUBLE ELSE 1 END AS fwd FROM f), d AS (SELECT symbol, abs((raw / lag(raw) OVER o - 1) - (fwd / lag(fwd) OVER o - 1)) AS gap FROM v WINDOW o AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, count(*) AS days, round(max(gap), 9) AS largest FROM d GROUP BY 1",
    "next_manifest": "WITH s AS (SELECT s_suppkey AS key, s_name AS file FROM supplier) SELECT key, file, CASE WHEN key % 3 = 0 THEN 2 ELSE 1 END AS run FROM s WHERE key % 7 <> 0 AND (key % 3 = 0 OR (key % 2 = 0 AND key % 5 <> 0))",
    "largest_gaps": f"WITH {BARS} SELECT symbol, date, round(fake, 9) AS fake FROM frame ORDER BY abs(fake) DESC NULLS LAST, symbol, date LIMIT 5",
    "constituents": "SELECT lpad((c_custkey % 500)::VARCHAR, 6, '0') AS code, min(c_name) AS name, 1 AS source FROM customer GROUP BY 1",
    "smallest_part": "SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS size FROM part ORDER BY size, p_partkey LIMIT 1",
    "pit_windows": f"WITH {PIT} SELECT * FROM found",
    "pit_statistics": f"WITH {PIT}, u AS (SELECT count(*) AS union_days FROM days WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT period, announced FROM facts) s WHERE day > period AND day <= announced)) SELECT count(*) AS windows, avg(trade_days) AS mean_days, sum(trade_days)::BIGINT AS sum_days, any_value(union_days) AS union_days, (SELECT count(*) FROM days) AS calendar_days, sum(trade_days)::BIGINT - any_value(union_days) AS overlap_days, any_value(union_days) / (SELECT count(*) FROM days) AS share FROM found, u",
    "trading_calendar": "SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)",
    "as_of_visible": "SELECT as_of, count(*) AS n, max(o_orderdate::DATE) AS latest FROM (SELECT make_date(y, 6, 30) AS as_of FROM range(1992, 2026) t(y)) JOIN orders ON o_orderdate::DATE <= as_of GROUP BY 1",
    "as_of_leaks": "WITH f AS (SELECT o_custkey AS key, min(o_orderdate::DATE) AS first_seen FROM orders GROUP BY 1) SELECT key, DATE '1993-01-01' + (c_custkey % 2000)::INT AS as_of, first_seen FROM customer JOIN f ON key = c_custkey WHERE first_seen > DATE '1993-01-01' + (c_custkey % 2000)::INT",
    "as_of_join": "WITH e AS (SELECT * FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), b AS (SELECT user_id, ts, max(value) AS value FROM e WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT event_id, c.user_id, b.value AS last_value FROM (SELECT * FROM e WHERE event_type = 'click') c ASOF LEFT JOIN b ON c.user_id = b.user_id AND c.ts >= b.ts",
    "carried_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM events",
    "attributed_forward": "WITH c AS (SELECT *, CASE WHEN role = 'assistant' THEN turn END AS mark FROM conversations) SELECT conv_id, turn, owner FROM (SELECT *, first_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS owner FROM c) WHERE mark IS NULL AND owner IS NOT NULL",
    "looked_back": "WITH c AS (SELECT *, CASE WHEN length(text) % 3 = 0 THEN turn END AS unit FROM conversations) SELECT conv_id, turn, coalesce(unit, lag(unit) OVER w, lag(unit, 2) OVER w) AS unit_used FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "upserted": "WITH n AS (SELECT s_suppkey + 30 AS key, s_name AS name, s_acctbal + 1 AS bal FROM supplier WHERE s_suppkey % 3 = 0) SELECT coalesce(n.key, s_suppkey) AS key, CASE WHEN n.key IS NULL THEN s_name ELSE n.name END AS name, CASE WHEN n.key IS NULL THEN s_acctbal ELSE n.bal END AS bal FROM supplier FULL JOIN n ON s_suppkey = n.key",
    "best_source": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate::DATE DESC, o_orderkey) = 1",
    "not_yet_fetched": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')",
    "equidistant_sample": "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rank, count(*) OVER () AS n FROM part) SELECT p_partkey, rank FROM p WHERE rank IN (SELECT i * n // 50 FROM range(50) t(i), (SELECT count(*) AS n FROM part))",
    "first_qualifying": "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice > 30000 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) = 1",
}
