"""Queries on scans, audits, ledgers, capability and gap diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, codes
from ..operators import asof, ranks, sets
from ..sources import readers, sinks
from ..streaming import candles as live
from . import tables
from .registry import query
from .research import ONE, one_bars

H = clock.HOUR
W = f"WITH {ONE}"
_DAY0 = 1704067200 * 10**9


@query(f"WITH {tables.TRADES} SELECT market, event_at_ns // {clock.DAY} AS day, count(*) AS n FROM trades GROUP BY 1, 2")
def raw_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-04: rows of each key and UTC day."""
    return readers.audit(tables.trades(spark, sf_dir), ["market"], "event_at_ns")


@query("""SELECT event_id, user_id, event_type FROM events""")
def price_free_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01, A-10, A-16: identity columns alone are read."""
    return readers.projected(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id", "event_type"])


@query(f"WITH {tables.TRADES} SELECT event_id, event_at_ns, price_nano FROM trades WHERE event_at_ns >= {_DAY0 + 3 * clock.DAY} AND event_at_ns < {_DAY0 + 5 * clock.DAY}")
def time_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-09, A-26, C-15: half-open range of time, in order."""
    t = tables.trades(spark, sf_dir)
    return readers.time_range(t, "event_at_ns", _DAY0 + 3 * clock.DAY, _DAY0 + 5 * clock.DAY).select("event_id", "event_at_ns", "price_nano")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-03-01' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-01-01'""")
def overlapping_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-27."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds("o_orderdate").alias("s")).withColumn("e", F.col("s") + 30 * 86400)
    return readers.overlapping(o, "s", "e", 883612800, 888710400).select("o_orderkey")


@query("""WITH i AS (SELECT l_suppkey, l_shipdate AS s, l_shipdate + INTERVAL 2 DAY AS e, l_orderkey, l_linenumber, l_partkey FROM lineitem), l AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (s < reach) AS overlaps FROM l GROUP BY 1""")
def selection_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-09: intervals that begin before an earlier one of their family has ended."""
    i = tables.table(spark, sf_dir, "lineitem").withColumn("s", F.unix_seconds("l_shipdate"))
    w = Window.partitionBy("l_suppkey").orderBy("s", "l_orderkey", "l_linenumber", "l_partkey")
    reach = F.max(F.col("s") + 2 * 86400).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return i.withColumn("reach", reach).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("s") < F.col("reach")).alias("overlaps"))


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 400000) AS large, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def decode_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-04: counters of a scan in one pass."""
    return tables.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("large"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count_distinct("o_custkey").alias("customers"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000000 WHEN event_id % 4 = 1 THEN epoch_us(ts) // 1000 WHEN event_id % 4 = 2 THEN epoch_us(ts) ELSE epoch_us(ts) * 1000 END * CASE event_id % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000 ELSE 1 END AS ns FROM events""")
def normalised_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-10: seconds, milli-, micro- and nanoseconds told by their size."""
    us = F.unix_micros("ts")
    raw = F.when(F.col("event_id") % 4 == 0, clock.floor_div(us, 10**6)).when(F.col("event_id") % 4 == 1, clock.floor_div(us, 1000)).when(F.col("event_id") % 4 == 2, us).otherwise(us * 1000)
    return tables.table(spark, sf_dir, "events").select("event_id", clock.normalised(raw).alias("ns"))


@query("""WITH s AS (SELECT p_partkey, upper(substr(p_name, 1, 2)) || substr('FGHJKMNQUVXZ', (p_partkey % 12 + 1)::INTEGER, 1) || (p_size % 100)::VARCHAR AS symbol FROM part) SELECT p_partkey, symbol, upper(substr(symbol, 1, 2)) AS root, (p_partkey % 12 + 1)::INTEGER AS month_no FROM s""")
def contract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-24."""
    p = tables.table(spark, sf_dir, "part")
    symbol = F.concat(F.upper(F.substring("p_name", 1, 2)), F.substring(F.lit("FGHJKMNQUVXZ"), (F.col("p_partkey") % 12 + 1).cast("int"), F.lit(1)), (F.col("p_size") % 100).cast("string"))
    return p.select("p_partkey", symbol.alias("symbol")).select("p_partkey", "symbol", codes.contract_root("symbol").alias("root"), codes.contract_month("symbol").alias("month_no"))


@query(
    """WITH RECURSIVE e AS (SELECT event_type, event_id, user_id, sha256(event_id::VARCHAR || '|' || user_id::VARCHAR) AS h, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), c AS (SELECT DISTINCT event_type, 0::BIGINT AS i, '' AS link FROM e UNION ALL SELECT e.event_type, e.i, sha256(c.link || e.h) FROM c JOIN e ON e.event_type = c.event_type AND e.i = c.i + 1)
SELECT e.event_type, e.event_id, e.user_id, c.link FROM e JOIN c ON c.event_type = e.event_type AND c.i = e.i"""
)
def hash_chained_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-21, K-28: each link holds all that came before it in its ledger."""
    e = tables.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    return sets.hash_chain(e, ["event_type"], "event_id", ["event_id", "user_id"])


@query("""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events WHERE event_id >= 100) WHERE n <= 50""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-10: by age and by number of rows."""
    return sinks.retained(tables.table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", 100, 50)


@query("""WITH l AS (SELECT o_custkey, list(o_totalprice ORDER BY o_totalprice) AS v FROM orders GROUP BY 1) SELECT o_custkey, v[round_even((len(v) - 1) * 0.6, 0)::INTEGER + 1] AS q FROM l""")
def nearest_index_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-09: the value at the index next to p (n - 1), which is another rank than ceil(p n)."""
    found = ranks.selected(tables.table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", {"q": ranks.nearest_index(0.6)})
    return found.select("o_custkey", "q")


@query(f"""{W}, d AS (SELECT market, event_at_ns // {clock.DAY} AS day, count(*) AS hours FROM one GROUP BY 1, 2) SELECT market, day, hours, CASE WHEN hours >= 24 THEN 'FULL' WHEN hours >= 20 THEN 'PARTIAL' ELSE 'SPARSE' END AS capability FROM d""")
def observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-04, O-10: what each day of a market supports."""
    d = one_bars(spark, sf_dir).groupBy("market", clock.floor_div("event_at_ns", clock.DAY).alias("day")).agg(F.count("*").alias("hours"))
    return d.withColumn("capability", F.when(F.col("hours") >= 24, "FULL").when(F.col("hours") >= 20, "PARTIAL").otherwise("SPARSE"))


@query(f"""{W}, c AS (SELECT DISTINCT market, event_at_ns // {clock.DAY} * {clock.DAY} + {15 * H} AS chk FROM one), g AS (SELECT market, chk, unnest(range(1, 7)) AS k FROM c), j AS (SELECT g.market, g.chk, g.k, CASE WHEN b.market IS NULL THEN 'MISSING' WHEN b.volume < 2 THEN 'NON_EXECUTABLE' WHEN b.available_at_ns > g.chk + {5 * clock.SECOND} THEN 'LATE' END AS code FROM g LEFT JOIN one b ON b.market = g.market AND b.event_at_ns = g.chk - g.k * {H})
SELECT market, chk AS checkpoint_ns, count(*) FILTER (code = 'MISSING') AS missing, count(*) FILTER (code = 'NON_EXECUTABLE') AS thin, count(*) FILTER (code = 'LATE') AS late, coalesce(arg_min(code, k) FILTER (code IS NOT NULL), 'COMPLETE') AS state FROM j GROUP BY 1, 2""")
def checkpoint_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-05, Q-21: what each required step before a checkpoint lacks."""
    b = one_bars(spark, sf_dir)
    chk = b.select("market", (clock.floor_to("event_at_ns", clock.DAY) + 15 * H).alias("checkpoint_ns")).distinct()
    g = chk.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("event_at_ns", F.col("checkpoint_ns") - F.col("k").cast("long") * H)
    j = g.join(b.select("market", "event_at_ns", "volume", "available_at_ns"), ["market", "event_at_ns"], "left")
    code = F.when(F.col("volume").isNull(), "MISSING").when(F.col("volume") < 2, "NON_EXECUTABLE").when(F.col("available_at_ns") > F.col("checkpoint_ns") + 5 * clock.SECOND, "LATE")
    j = j.withColumn("code", code)
    n = lambda c: F.count_if(F.col("code") == c)
    first = F.min_by("code", F.when(F.col("code").isNotNull(), F.col("k")))
    return j.groupBy("market", "checkpoint_ns").agg(n("MISSING").alias("missing"), n("NON_EXECUTABLE").alias("thin"), n("LATE").alias("late"), F.coalesce(first, F.lit("COMPLETE")).alias("state"))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders), t AS (SELECT s, k FROM (VALUES ('candidate'), ('flat'), ('feature')) x(s), (SELECT o_custkey AS k FROM a)) SELECT s AS strategy, count(*) AS expected, count(*) FILTER (s = 'flat' OR (s = 'feature' AND k % 2 = 0) OR (s = 'candidate' AND k % 3 = 0)) AS eligible FROM t GROUP BY 1""")
def strategy_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-06: every strategy has its own universe, generated from the census."""
    k = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    t = k.withColumn("strategy", F.explode(F.array(*(F.lit(x) for x in ("candidate", "flat", "feature")))))
    ok = F.when(F.col("strategy") == "flat", True).when(F.col("strategy") == "feature", F.col("k") % 2 == 0).otherwise(F.col("k") % 3 == 0)
    return t.groupBy("strategy").agg(F.count("*").alias("expected"), F.count_if(ok).alias("eligible"))


@query("""SELECT o_custkey, array_to_string(list_sort(list_filter([CASE WHEN count(*) < 5 THEN 'FEW_TRADES' END, CASE WHEN sum(o_totalprice) < 1500000 THEN 'NET' END, CASE WHEN max(o_totalprice) > 0.4 * sum(o_totalprice) THEN 'CONCENTRATED' END], lambda x: x IS NOT NULL)), ',') AS failed,
CASE WHEN count(*) >= 5 AND sum(o_totalprice) >= 1500000 AND max(o_totalprice) <= 0.4 * sum(o_totalprice) THEN 'ACCEPT' ELSE 'REJECT' END AS decision FROM orders GROUP BY 1""")
def decision_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-11, L-13: all gates, and the decision that they make."""
    o = tables.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("net"), F.max("o_totalprice").alias("top"))
    failed = codes.reasons((F.col("n") >= 5, "FEW_TRADES"), (F.col("net") >= 1500000, "NET"), (F.col("top") <= 0.4 * F.col("net"), "CONCENTRATED"))
    return o.select("o_custkey", F.array_join(failed, ",").alias("failed"), F.when(F.size(failed) == 0, "ACCEPT").otherwise("REJECT").alias("decision"))


@query("""WITH f AS (SELECT l_orderkey AS k, sum(l_quantity)::BIGINT AS filled FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN f.k IS NULL THEN 'NO_FILL' WHEN filled > 200 THEN 'OVERFILLED' ELSE 'MATCHED' END AS state FROM orders LEFT JOIN f ON o_orderkey = f.k""")
def broker_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-29: orders held against their fills."""
    f = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("filled"))
    state = F.when(F.col("filled").isNull(), "NO_FILL").when(F.col("filled") > 200, "OVERFILLED").otherwise("MATCHED")
    return tables.table(spark, sf_dir, "orders").join(f, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("""WITH l AS (SELECT event_type AS market, max(epoch_us(ts) * 1000) AS last_ns FROM events WHERE event_type <> 'error' OR day(ts) < 20 GROUP BY 1) SELECT market, last_ns, 1706572800000000000 - last_ns AS age_ns, CASE WHEN 1706572800000000000 - last_ns > 86400000000000 THEN 'STALE' ELSE 'LIVE' END AS state FROM l""")
def stale_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-04: markets by the age of what is known of them."""
    t = tables.trades(spark, sf_dir).where("market <> 'error' OR dayofmonth(ts) < 20")
    return live.stale(t.groupBy("market").agg(F.max("event_at_ns").alias("last_ns")), 1706572800000000000, clock.DAY)


@query("""WITH w AS (SELECT user_id, max(epoch_us(ts) * 1000) FILTER (event_type = 'view') AS m FROM events GROUP BY 1) SELECT user_id, coalesce(m, -1) AS watermark_ns, greatest(1706000000000000000, coalesce(m, 1706000000000000000)) AS replay_from_ns FROM w""")
def replay_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-05: where each key's next replay begins."""
    w = tables.trades(spark, sf_dir).groupBy(F.col("instrument_id").alias("user_id")).agg(F.max(F.when(F.col("market") == "view", F.col("event_at_ns"))).alias("watermark_ns"))
    return live.replay_start(w, 1706000000000000000).withColumn("watermark_ns", F.coalesce("watermark_ns", F.lit(-1).cast("long")))


@query("""SELECT user_id, count(*) AS rows_seen, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def grouped_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-03: a given function over the rows of each key, in batches."""

    def summary(key, pdf):
        import pandas as pd

        return pd.DataFrame([(key[0], len(pdf), round(float(pdf["value"].sum()), 2))], columns=["user_id", "rows_seen", "total"])

    e = tables.table(spark, sf_dir, "events").select("user_id", "value")
    return e.groupBy("user_id").applyInPandas(summary, "user_id long, rows_seen long, total double")


@query("""WITH s AS (SELECT event_id, value > 25 AS resolved FROM events) SELECT event_id, resolved, CASE WHEN resolved THEN 'READY' ELSE 'UNRESOLVED_FAIL_CLOSED' END AS disposition FROM s""")
def resolved_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-34: unresolved rows stay in the denominator."""
    ok = F.col("value") > 25
    return tables.table(spark, sf_dir, "events").select("event_id", ok.alias("resolved"), F.when(ok, "READY").otherwise("UNRESOLVED_FAIL_CLOSED").alias("disposition"))


@query("""WITH e AS (SELECT epoch_us(ts) * 1000 AS t, event_id FROM events), n AS (SELECT 1704067200000000000 + i * 43200000000000 AS at0 FROM range(0, 60) r(i)) SELECT event_id, count(at0) > 0 AS blocked FROM e LEFT JOIN n ON t >= at0 - 1800000000000 AND t < at0 + 900000000000 GROUP BY event_id""")
def news_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-24: instants inside a window around a scheduled event."""
    at = F.lit(_DAY0) + F.col("id") * 43200000000000
    n = spark.range(60).select(F.lit(1).alias("key"), (at - 1800 * clock.SECOND).alias("s"), (at + 900 * clock.SECOND).alias("e"), F.lit(True).alias("hit"))
    t = tables.trades(spark, sf_dir).select(F.lit(1).alias("key"), "event_id", "event_at_ns")
    return asof.in_interval(t, n, ["key"], "event_at_ns", "s", "e", ["hit"], 6 * H).select("event_id", F.coalesce("hit", F.lit(False)).alias("blocked"))
