"""Queries on as-of, interval and reconciling joins, and on sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import asof, sets
from . import tables
from .registry import query

H = clock.HOUR
W = f"WITH {tables.bars_sql()}"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.trades(spark, sf_dir).where("market in ('error', 'signup')")
    return t.select("instrument_id", F.col("event_at_ns").alias("received_ns"), F.when(F.col("market") == "error", "HALT").otherwise("TRADING").alias("action"), "event_id")


_STATUS = "s AS (SELECT instrument_id, event_at_ns AS received_ns, CASE WHEN market = 'error' THEN 'HALT' ELSE 'TRADING' END AS action, event_id FROM trades WHERE market IN ('error', 'signup'))"


@query(
    f"""WITH {tables.TRADES}, {_STATUS} SELECT t.event_id, t.instrument_id, coalesce(s.received_ns, -1) AS known_at, s.action, CASE WHEN s.action IS NULL THEN 'STATUS_UNRESOLVED' WHEN s.action = 'HALT' THEN 'STATUS_NOT_TRADING' ELSE 'STATUS_ELIGIBLE' END AS state
FROM (SELECT * FROM trades WHERE market = 'purchase') t ASOF LEFT JOIN s ON t.instrument_id = s.instrument_id AND t.event_at_ns >= s.received_ns"""
)
def status_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-02, B-12: the last status received by each decision."""
    d = tables.trades(spark, sf_dir).where("market = 'purchase'").select("instrument_id", "event_at_ns", "event_id")
    found = asof.as_of(d, _status(spark, sf_dir), ["instrument_id"], "event_at_ns", "received_ns", ["action"], span=7 * clock.DAY)
    state = F.when(F.col("action").isNull(), "STATUS_UNRESOLVED").when(F.col("action") == "HALT", "STATUS_NOT_TRADING").otherwise("STATUS_ELIGIBLE")
    return found.select("event_id", "instrument_id", F.coalesce("known_at", F.lit(-1)).alias("known_at"), "action", state.alias("state"))


@query(f"""WITH {tables.TRADES}, {_STATUS} SELECT t.event_id, coalesce(s.event_id, -1) AS known_event FROM (SELECT * FROM trades WHERE market IN ('error', 'signup')) t ASOF LEFT JOIN s ON t.instrument_id = s.instrument_id AND t.event_at_ns > s.received_ns""")
def status_asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-02: the state strictly before an event, from the same log."""
    s = _status(spark, sf_dir)
    d = s.select("instrument_id", F.col("received_ns").alias("at"), "event_id")
    found = asof.as_of(d, s.withColumnRenamed("event_id", "known_event"), ["instrument_id"], "at", "received_ns", ["known_event"], strict=True, span=7 * clock.DAY)
    return found.select("event_id", F.coalesce("known_event", F.lit(-1).cast("long")).alias("known_event"))


@query(
    f"""WITH {tables.TRADES}, c AS (SELECT instrument_id, event_at_ns // {clock.DAY} AS day, market AS source, event_id AS ordinal, value > 50 AS high FROM trades),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY instrument_id, day, source ORDER BY ordinal DESC) = 1)
SELECT instrument_id, day, arg_min(high, source) AS high, count(DISTINCT high) > 1 AS conflict FROM l GROUP BY 1, 2"""
)
def tie_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-04: per key and time each source's last word; sources that differ are a conflict."""
    t = tables.trades(spark, sf_dir)
    c = t.select("instrument_id", clock.floor_div("event_at_ns", clock.DAY).alias("day"), F.col("market").alias("source"), F.col("event_id").alias("ordinal"), (F.col("value") > 50).alias("high"))
    return asof.tied(c, ["instrument_id"], "day", "source", "ordinal", ["high"])


@query(
    f"""WITH {tables.TRADES}, r AS (SELECT market, contract, min(event_at_ns) AS effective FROM trades GROUP BY 1, 2), d AS (SELECT DISTINCT market, event_at_ns // {clock.DAY} * {clock.DAY} + {12 * H} AS decided FROM trades)
SELECT d.market, d.decided, r.contract FROM d ASOF LEFT JOIN (SELECT *, effective + {6 * H} AS known FROM r) r ON d.market = r.market AND d.decided >= r.known"""
)
def roll_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-05: the contract in effect, as known six hours later."""
    t = tables.trades(spark, sf_dir)
    r = t.groupBy("market", "contract").agg((F.min("event_at_ns") + 6 * H).alias("known"))
    d = t.select("market", (clock.floor_to("event_at_ns", clock.DAY) + 12 * H).alias("decided")).distinct()
    return asof.as_of(d, r, ["market"], "decided", "known", ["contract"], span=7 * clock.DAY).select("market", "decided", "contract")


@query(
    f"""WITH {tables.TRADES}, c AS (SELECT 'market_' || i AS name, i * {3 * H} + {1704067200 * 10**9} AS s, i * {3 * H} + {2 * H} + {1704067200 * 10**9} AS e, CASE WHEN i % 3 = 0 THEN 'HALT' ELSE 'OPEN' END AS state FROM range(0, 240) t(i))
SELECT t.event_id, coalesce(c.state, 'UNRESOLVED') AS state FROM trades t LEFT JOIN c ON t.event_at_ns >= c.s AND t.event_at_ns < c.e"""
)
def calendar_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-10, D-11, Q-33, K-24: the calendar interval that holds each instant."""
    i = F.col("id")
    c = spark.range(240).select(F.lit("all").alias("key"), (i * 3 * H + 1704067200 * 10**9).alias("s"), (i * 3 * H + 2 * H + 1704067200 * 10**9).alias("e"), F.when(i % 3 == 0, "HALT").otherwise("OPEN").alias("state"))
    t = tables.trades(spark, sf_dir).select(F.lit("all").alias("key"), "event_id", "event_at_ns")
    found = asof.in_interval(t, c, ["key"], "event_at_ns", "s", "e", ["state"], 6 * H)
    return found.select("event_id", F.coalesce("state", F.lit("UNRESOLVED")).alias("state"))


@query("""SELECT l.l_orderkey, l.l_linenumber, p.p_size * 25 AS tick_cents, round(p.p_size * 25 * p.p_retailprice, 4) AS tick_value, p.p_size % 2 = 0 AS unit_matches FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 10""")
def economics_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-33: contract economics for each row."""
    p = tables.table(spark, sf_dir, "part").where("p_size > 10")
    i = tables.table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return i.select("l_orderkey", "l_linenumber", (F.col("p_size") * 25).alias("tick_cents"), F.round(F.col("p_size") * 25 * F.col("p_retailprice"), 4).alias("tick_value"), (F.col("p_size") % 2 == 0).alias("unit_matches"))


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name""")
def prediction_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-14: exact joins on ids, then a sum."""
    o, c, n = (tables.table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    j = o.where("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT count(*) FILTER (o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL) AS matched, count(*) FILTER (l_orderkey IS NULL) AS without_lines, count(*) FILTER (o_orderkey IS NULL) AS without_order FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey""")
def pair_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-13: a one-to-one join and what has no partner on either side."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey")
    i = tables.table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    j = o.join(i, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    a, b = F.col("o_orderkey").isNotNull(), F.col("l_orderkey").isNotNull()
    return j.agg(F.count_if(a & b).alias("matched"), F.count_if(~b).alias("without_lines"), F.count_if(~a).alias("without_order"))


@query(f"""{W}, a AS (SELECT market, event_at_ns // {4 * H} AS k, sum(volume)::BIGINT AS v FROM bars GROUP BY 1, 2), b AS (SELECT market, event_at_ns // {4 * H} AS k, count(*) AS v FROM trades WHERE event_id % 97 <> 0 GROUP BY 1, 2)
SELECT coalesce(a.market, b.market) AS market, coalesce(a.k, b.k) AS bucket, CASE WHEN a.k IS NULL THEN 'RIGHT_ONLY' WHEN b.k IS NULL THEN 'LEFT_ONLY' WHEN a.v = b.v THEN 'EQUAL' ELSE 'DIFFERENT' END AS state FROM a FULL JOIN b ON a.market = b.market AND a.k = b.k""")
def coverage_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-22, H-05, O-02: aggregates held against those of another source."""
    a = tables.bars(spark, sf_dir).groupBy("market", clock.floor_div("event_at_ns", 4 * H).alias("bucket")).agg(F.sum("volume").alias("v"))
    b = tables.trades(spark, sf_dir).where("event_id % 97 <> 0").groupBy("market", clock.floor_div("event_at_ns", 4 * H).alias("bucket")).agg(F.count("*").alias("v"))
    return asof.reconciled(a, b, ["market", "bucket"], ["v"])


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)""")
def semi_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-03, D-24, D-25: rows whose key is needed."""
    need = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return tables.table(spark, sf_dir, "supplier").join(need, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-06: keys that the other side lacks."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


_DAY0 = 1704067200 * 10**9


@query(
    f"""{W}, g AS (SELECT market, d, c FROM (SELECT DISTINCT market FROM bars), range(0, 30) a(d), (VALUES (15), (17), (19)) b(c)), k AS (SELECT market, {_DAY0} + d * {clock.DAY} + c * {H} AS at FROM g)
SELECT k.market, k.at AS checkpoint_ns, CASE WHEN b.open_nano IS NULL THEN 'ABSTAIN_NO_BAR' WHEN b.volume < 2 THEN 'ABSTAIN_THIN' ELSE 'READY' END AS state FROM k LEFT JOIN (SELECT market, event_at_ns, max(open_nano) AS open_nano, sum(volume) AS volume FROM bars GROUP BY 1, 2) b ON b.market = k.market AND b.event_at_ns = k.at"""
)
def opportunity_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-21, D-26: the calendar's census drives; what is missing abstains and stays counted."""
    b = tables.bars(spark, sf_dir).groupBy("market", "event_at_ns").agg(F.max("open_nano").alias("open_nano"), F.sum("volume").alias("volume"))
    markets = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("market")).distinct()
    grid = markets.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("c", F.explode(F.array(F.lit(15), F.lit(17), F.lit(19))))
    grid = grid.select("market", (F.lit(_DAY0) + F.col("d").cast("long") * clock.DAY + F.col("c").cast("long") * H).alias("event_at_ns"))
    state = F.when(F.col("open_nano").isNull(), "ABSTAIN_NO_BAR").when(F.col("volume") < 2, "ABSTAIN_THIN").otherwise("READY")
    return grid.join(b, ["market", "event_at_ns"], "left").select("market", F.col("event_at_ns").alias("checkpoint_ns"), state.alias("state"))


@query(f"""{W}, p AS (SELECT market, event_at_ns, arg_min(contract, contract) AS contract FROM bars GROUP BY 1, 2) SELECT a.market, a.event_at_ns, CASE WHEN b.contract IS NULL THEN 'MISSING' WHEN a.contract <> b.contract THEN 'ROLLED' ELSE 'SAME' END AS exit_state FROM p a LEFT JOIN p b ON b.market = a.market AND b.event_at_ns = a.event_at_ns + {4 * H}""")
def entry_exit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-23: bars looked up at entry and exit; a changed contract is excluded."""
    p = tables.bars(spark, sf_dir).groupBy("market", "event_at_ns").agg(F.min("contract").alias("contract"))
    later = p.select("market", (F.col("event_at_ns") - 4 * H).alias("event_at_ns"), F.col("contract").alias("then"))
    state = F.when(F.col("then").isNull(), "MISSING").when(F.col("contract") != F.col("then"), "ROLLED").otherwise("SAME")
    return p.join(later, ["market", "event_at_ns"], "left").select("market", "event_at_ns", state.alias("exit_state"))


@query("""SELECT user_id, event_type, count(*) AS n, CASE WHEN count(*) = 1 THEN 'UNIQUE' WHEN count(DISTINCT props) = 1 THEN 'EXACT_DUPLICATE' ELSE 'DISTINCT_UPDATE' END AS kind FROM events GROUP BY 1, 2""")
def duplicate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-01: duplicate kinds."""
    return sets.duplicates(tables.table(spark, sf_dir, "events"), ["user_id", "event_type"], ["props"])


@query("""WITH u AS (SELECT user_id, event_type, event_id, value, 0 AS p FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, event_id, value + 1, 1 FROM events WHERE event_id % 3 = 0)
SELECT user_id, event_type, event_id, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY p DESC, event_id DESC) = 1""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-16, H-02, H-03, H-04: new rows win, later ones over earlier."""
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return sets.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1), ["user_id", "event_type"], "event_id")


@query("""SELECT 'left' AS side, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2) HAVING count(*) > 0
UNION ALL SELECT 'right', count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1) HAVING count(*) > 0""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-05, H-06, O-02."""
    i = tables.table(spark, sf_dir, "lineitem")
    return sets.same_sets(i.where("l_linenumber = 1").select("l_suppkey"), i.where("l_linenumber = 2").select("l_suppkey"))


@query("""WITH h AS (SELECT o_orderstatus, sha256(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || o_orderpriority) AS h FROM orders)
SELECT o_orderstatus, count(*) AS n, (sum(('0x' || substr(h, 1, 8))::BIGINT) % 4294967296)::BIGINT AS q0, (sum(('0x' || substr(h, 9, 8))::BIGINT) % 4294967296)::BIGINT AS q1, (sum(('0x' || substr(h, 17, 8))::BIGINT) % 4294967296)::BIGINT AS q2, (sum(('0x' || substr(h, 25, 8))::BIGINT) % 4294967296)::BIGINT AS q3 FROM h GROUP BY 1""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01, O-09, B-19: independent of files and order."""
    return sets.fingerprint(tables.table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("""WITH c AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20), p AS (SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'RENAMED' ELSE n_name END AS n_name FROM nation), j AS (SELECT c.n_nationkey AS a, p.n_nationkey AS b, c.n_name IS DISTINCT FROM p.n_name AS differs FROM c FULL JOIN p USING (n_nationkey))
SELECT CASE WHEN count(a) = 0 THEN 'INITIAL' WHEN count(*) FILTER (b IS NULL OR (a IS NOT NULL AND differs)) > 0 THEN 'FULL_SUCCESSOR' WHEN count(*) FILTER (a IS NULL) > 0 THEN 'APPEND_ONLY' ELSE 'UNCHANGED' END AS mode, count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL OR (a IS NOT NULL AND differs)) AS changed FROM j""")
def catalog_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-25, D-23."""
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    proposed = n.withColumn("n_name", F.when(F.col("n_nationkey") == 7, "RENAMED").otherwise(F.col("n_name")))
    return sets.catalog_update(n.where("n_nationkey < 20"), proposed, ["n_nationkey"], ["n_name"])


@query("""WITH g AS (SELECT market, y FROM (SELECT DISTINCT event_type AS market FROM events), range(2022, 2026) t(y)), c AS (SELECT event_type AS market, year(ts) AS y, count(*) AS n FROM events GROUP BY 1, 2)
SELECT g.market, g.y AS year, CASE WHEN c.n IS NULL THEN 'ABSENT' WHEN c.n < 100 THEN 'THIN' ELSE 'RESOLVABLE' END AS state FROM g LEFT JOIN c USING (market, y)""")
def catalog_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18, O-11: the requested grid against what there is."""
    e = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("market"), F.year("ts").cast("long").alias("year"))
    have = e.groupBy("market", "year").agg(F.count("*").alias("n"))
    grid = e.select("market").distinct().withColumn("year", F.explode(F.sequence(F.lit(2022).cast("long"), F.lit(2025).cast("long"))))
    state = F.when(F.col("n").isNull(), "ABSENT").when(F.col("n") < 100, "THIN").otherwise("RESOLVABLE")
    return grid.join(have, ["market", "year"], "left").select("market", "year", state.alias("state"))


@query(f"""WITH {tables.TRADES}, q AS (SELECT market, event_at_ns // {H} AS h, count(DISTINCT instrument_id) AS n FROM trades GROUP BY 1, 2), g AS (SELECT market, h FROM (SELECT DISTINCT market FROM q), (SELECT DISTINCT h FROM q))
SELECT g.market, g.h AS hour_no, CASE WHEN coalesce(n, 0) = 0 THEN 'ABSENT' WHEN n = 1 THEN 'PRESENT' ELSE 'AMBIGUOUS' END AS presence FROM g LEFT JOIN q USING (market, h)""")
def target_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-22: no, one or several candidates per target."""
    t = tables.trades(spark, sf_dir).select("market", clock.floor_div("event_at_ns", H).alias("hour_no"), "instrument_id")
    hours = t.agg(F.collect_set("hour_no").alias("hours"))  # one row; as many hours as the calendar has
    grid = t.select("market").distinct().join(F.broadcast(hours)).select("market", F.explode("hours").alias("hour_no"))
    return asof.only_match(grid.join(t, ["market", "hour_no"], "left"), ["market", "hour_no"], "instrument_id")


@query("""WITH m AS (SELECT event_type AS market, 'events' AS src FROM events UNION SELECT lower(o_orderstatus), 'orders' FROM orders UNION SELECT lower(l_returnflag), 'lines' FROM lineitem)
SELECT market, bool_or(src = 'events') AS in_events, bool_or(src = 'orders') AS in_orders, bool_or(src = 'lines') AS in_lines, CASE WHEN count(*) > 1 THEN 'SHARED' ELSE 'SINGLE' END AS state FROM m GROUP BY market""")
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-08: presence of each name in several sets."""
    part = lambda t, c, n: tables.table(spark, sf_dir, t).select(F.lower(c).alias("market"), F.lit(n).alias("src"))
    m = part("events", "event_type", "events").union(part("orders", "o_orderstatus", "orders")).union(part("lineitem", "l_returnflag", "lines")).distinct()
    has = lambda n: F.bool_or(F.col("src") == n).alias(f"in_{n}")
    return m.groupBy("market").agg(has("events"), has("orders"), has("lines"), F.when(F.count("*") > 1, "SHARED").otherwise("SINGLE").alias("state"))


@query("""SELECT o_custkey, min(o_totalprice) AS p0, quantile_disc(o_totalprice, 0.25) AS p25, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, max(o_totalprice) AS p100 FROM orders GROUP BY 1""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-07, E-08, E-09."""
    return sets.percentiles(tables.table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", (0.0, 0.25, 0.5, 0.95, 1.0))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg((o_orderstatus <> 'P')::INT), 9) AS terminal, round(avg((o_totalprice > 1000)::INT), 9) AS priced, avg((o_orderstatus <> 'P')::INT) >= 0.5 AND avg((o_totalprice > 1000)::INT) >= 0.99 AS passed FROM orders GROUP BY 1""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-10, O-10, Q-24: coverage gate."""
    o = tables.table(spark, sf_dir, "orders")
    found = sets.coverage_gate(o, ["o_orderpriority"], {"terminal": F.col("o_orderstatus") != "P", "priced": F.col("o_totalprice") > 1000}, {"terminal": 0.5, "priced": 0.99})
    return found.withColumns({c: F.round(c, 9) for c in ("terminal", "priced")})


@query("""SELECT market, source, round(score, 6) AS score FROM (SELECT p_type AS market, p_brand AS source, avg(p_retailprice) AS score FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY market ORDER BY score DESC, source) = 1""")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-07: the best candidate of each key, ties by name."""
    p = tables.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("market"), F.col("p_brand").alias("source")).agg(F.avg("p_retailprice").alias("score"))
    n = F.row_number().over(Window.partitionBy("market").orderBy(F.desc("score"), "source"))
    return p.withColumn("n", n).where("n = 1").select("market", "source", F.round("score", 6).alias("score"))


@query("""SELECT l_returnflag, l_linestatus, coalesce(year(l_shipdate), 0) AS year, count(*) AS n, round(sum(l_extendedprice), 2) AS gross FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (year(l_shipdate)), ())""")
def diagnosis_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-08, E-18: one pass for several groupings."""
    tables.table(spark, sf_dir, "lineitem").createOrReplaceTempView("diagnosis_lines")
    return spark.sql("SELECT l_returnflag, l_linestatus, coalesce(year(l_shipdate), 0) AS year, count(*) AS n, round(sum(l_extendedprice), 2) AS gross FROM diagnosis_lines GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (year(l_shipdate)), ())")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') ORDER BY p_brand = 'Brand#2' DESC, p_partkey""")
def market_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-09, G-11: search over names, one brand first."""
    p = tables.table(spark, sf_dir, "part").where(F.lower("p_name").contains("ring") | F.lower("p_brand").contains("ring"))
    return p.orderBy((F.col("p_brand") == "Brand#2").desc(), "p_partkey").select("p_partkey", "p_name")


@query("""WITH s AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 500 DAY AS e FROM orders), y AS (SELECT *, unnest(generate_series(year(s), year(e - INTERVAL 1 MICROSECOND))) AS y FROM s)
SELECT o_orderkey, y::BIGINT AS year, greatest(s, make_timestamp(y, 1, 1, 0, 0, 0))::DATE::VARCHAR AS first_day, least(e, make_timestamp(y + 1, 1, 1, 0, 0, 0))::DATE::VARCHAR AS end_day FROM y""")
def interval_year_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-26: half-open intervals cut at year boundaries."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), 500).alias("e"))
    y = o.withColumn("year", F.explode(F.sequence(F.year("s"), F.year(F.date_sub("e", 1)))))
    first = F.greatest("s", F.make_date("year", F.lit(1), F.lit(1)))
    return y.select("o_orderkey", F.col("year").cast("long").alias("year"), first.cast("string").alias("first_day"), F.least("e", F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))).cast("string").alias("end_day"))
