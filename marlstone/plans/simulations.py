"""Queries on accounts that are simulated event by event; their SQL is a recursion over the numbered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import accounts
from . import tables
from .registry import query

H = clock.HOUR
_T0 = 1704067200 * 10**9


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third trade as an order of one of twelve accounts, entering with the next hour, in cents."""
    i = F.col("event_id")
    at = clock.floor_to("event_at_ns", H) + H
    cents = F.round(F.col("value") * 100).cast("long")
    return tables.trades(spark, sf_dir).where("event_id % 3 = 0").select(
        (F.col("instrument_id") % 12).alias("account"), i.alias("order_id"), clock.utc_date(at).cast("string").alias("session"), "market", F.when(i % 2 == 0, 1).otherwise(-1).alias("side"), at.alias("at"), cents.alias("entry"),
        (at + (1 + i % 5) * H).alias("exit_at"), (cents + (i * 37) % 4001 - 1900).alias("exit_price"), (i % 7 * 2).alias("fee"), (i * 13 % 270).alias("loss"), ((i * 29) % 101).cast("double").alias("score"))


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per market and hour, in cents."""
    t = tables.trades(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return t.groupBy("market", clock.floor_to("event_at_ns", H).alias("at")).agg(
        F.min_by("c", F.struct("event_at_ns", "event_id")).alias("open"), F.max("c").alias("high"), F.min("c").alias("low"), F.max_by("c", F.struct("event_at_ns", "event_id")).alias("close"))


_EVENTS = f"""{tables.TRADES}, t AS (SELECT *, round(value * 100)::BIGINT AS c, event_at_ns // {H} * {H} AS h FROM trades),
b AS MATERIALIZED (SELECT market, h AS tm, arg_min(c, (event_at_ns, event_id)) AS open, max(c) AS high, min(c) AS low, arg_max(c, (event_at_ns, event_id)) AS close FROM t GROUP BY 1, 2),
o AS MATERIALIZED (SELECT instrument_id % 12 AS account, event_id AS order_id, make_timestamp((h + {H}) // 1000)::DATE::VARCHAR AS session, market, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, h + {H} AS tm, c AS entry,
  h + {H} + (1 + event_id % 5) * {H} AS exit_at, c + (event_id * 37) % 4001 - 1900 AS exit_price, event_id % 7 * 2 AS fee, event_id * 13 % 270 AS loss, (event_id * 29) % 101 AS score FROM t WHERE event_id % 3 = 0),
f AS (SELECT DISTINCT account, {_T0} + k * {24 * H} + {21 * H} AS tm FROM o, range(0, 40) r(k)),
e AS (SELECT DISTINCT o.account, b.tm, 0 AS rank, 0.0::DOUBLE AS tie, NULL::BIGINT AS order_id, NULL AS session, b.market, NULL::INT AS side, NULL::BIGINT AS entry, NULL::BIGINT AS fee, NULL::BIGINT AS loss, NULL::BIGINT AS exit_price, b.open, b.high, b.low, b.close FROM o JOIN b ON b.market = o.market AND b.tm BETWEEN o.tm AND o.exit_at + {3 * H}
  UNION ALL SELECT account, exit_at, 1, 0, order_id, NULL, NULL, NULL, NULL, NULL, NULL, exit_price, NULL, NULL, NULL, NULL FROM o
  UNION ALL SELECT account, tm, 2, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f
  UNION ALL SELECT o.account, o.tm, 3, -o.score, o.order_id, o.session, o.market, o.side, o.entry, o.fee, o.loss, NULL, b.open, b.high, b.low, b.close FROM o LEFT JOIN b ON b.market = o.market AND b.tm = o.tm
  UNION ALL SELECT DISTINCT account, 9223372036854775807, 4, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account ORDER BY tm, rank, tie, order_id::VARCHAR NULLS FIRST, market NULLS FIRST) AS i FROM e)"""

_COLUMNS = "oid, mk, ps, side, ent, fee, pstart, equity, peak, worst, session, start, entries, blocked, halted, pending, last, until"
_SIMULATION = f"""WITH RECURSIVE {_EVENTS},
s AS (SELECT DISTINCT account, 0::BIGINT AS i, NULL::BIGINT AS oid, NULL::VARCHAR AS mk, NULL::VARCHAR AS ps, NULL::INT AS side, NULL::BIGINT AS ent, NULL::BIGINT AS fee, NULL::BIGINT AS pstart, 10000::BIGINT AS equity, 10000::BIGINT AS peak, 0::BIGINT AS worst,
  NULL::VARCHAR AS session, 10000::BIGINT AS start, 0::BIGINT AS entries, false AS blocked, false AS halted, NULL::VARCHAR AS pending, NULL::BIGINT AS last, (-9223372036854775808)::BIGINT AS until, NULL::BIGINT AS order_id, NULL::VARCHAR AS state, 0::BIGINT AS tm, 0::BIGINT AS net FROM n
UNION ALL SELECT account, i, CASE WHEN how IS NULL THEN oid END, mk, ps, side, ent, fee, pstart, coalesce(after, equity), peak, CASE WHEN mark THEN greatest(worst, peak - down) WHEN after IS NOT NULL THEN greatest(worst, peak - after) ELSE worst END,
  session, start, entries, blocked OR (coalesce(how, '') = 'RISK_DAILY' AND ps = session), halted OR coalesce(how, '') = 'RISK_DRAWDOWN' OR coalesce(peak - after >= 40000, false),
  CASE WHEN mark THEN CASE WHEN peak - down >= 40000 THEN 'RISK_DRAWDOWN' WHEN pstart - down >= 2500 THEN 'RISK_DAILY' END WHEN how IS NULL THEN pending END, CASE WHEN mark THEN close ELSE last END, CASE WHEN after IS NOT NULL THEN tm ELSE until END,
  CASE WHEN why IS NOT NULL THEN eid WHEN how IS NOT NULL THEN oid END, coalesce(why, how), tm, coalesce(after - equity, 0)
FROM (SELECT *, CASE WHEN mark THEN greatest(peak0, good) WHEN how IN ('EXIT', 'FLATTENED') THEN greatest(peak0, after) ELSE peak0 END AS peak FROM (
SELECT *, CASE WHEN mark THEN equity + side * (CASE WHEN side > 0 THEN high ELSE low END - ent) - fee END AS good, CASE WHEN mark THEN equity + side * (CASE WHEN side > 0 THEN low ELSE high END - ent) - fee END AS down, CASE WHEN how <> 'INCOMPLETE' THEN equity + side * (price - ent) - fee END AS after FROM (
SELECT account, i, tm, eid, why, how, price, equity, worst, session, start, blocked, halted, pending, until, high, low, close, entries + enter::INT AS entries, CASE WHEN enter THEN eid ELSE oid END AS oid, CASE WHEN enter THEN market ELSE mk END AS mk, CASE WHEN enter THEN session ELSE ps END AS ps, CASE WHEN enter THEN eside ELSE side END AS side,
  CASE WHEN enter THEN eentry ELSE ent END AS ent, CASE WHEN enter THEN efee ELSE fee END AS fee, CASE WHEN enter THEN start ELSE pstart END AS pstart, CASE WHEN enter THEN greatest(peak, equity) ELSE peak END AS peak0, CASE WHEN NOT enter THEN last END AS last, (enter AND high IS NOT NULL) OR (rank = 0 AND oid IS NOT NULL AND market = mk AND pending IS NULL) AS mark FROM (
SELECT *, rank = 3 AND why IS NULL AS enter FROM (
SELECT *, CASE WHEN rank <> 3 THEN NULL WHEN loss > 250 THEN 'RISK_CAP' WHEN oid IS NOT NULL OR tm <= until THEN 'OVERLAP' WHEN blocked THEN 'DAILY_STOP' WHEN halted THEN 'DRAWDOWN' WHEN entries >= 3 THEN 'ENTRY_CAP' END AS why,
  CASE WHEN oid IS NULL THEN NULL WHEN rank = 0 AND market = mk AND pending IS NOT NULL THEN pending WHEN rank = 1 AND eid = oid AND pending IS NULL THEN 'EXIT' WHEN rank = 2 AND pending IS NULL THEN CASE WHEN last IS NULL THEN 'INCOMPLETE' ELSE 'FLATTENED' END WHEN rank = 4 THEN 'INCOMPLETE' END AS how,
  CASE rank WHEN 0 THEN open WHEN 1 THEN exit_price ELSE last END AS price FROM (
SELECT s.account, n.i, n.tm, n.rank, n.order_id AS eid, n.market, n.side AS eside, n.entry AS eentry, n.fee AS efee, n.loss, n.exit_price, n.open, n.high, n.low, n.close, s.oid, s.mk, s.ps, s.side, s.ent, s.fee, s.pstart, s.equity, s.peak, s.worst, s.halted, s.pending, s.last, s.until,
  CASE WHEN new THEN n.session ELSE s.session END AS session, CASE WHEN new THEN s.equity ELSE s.start END AS start, CASE WHEN new THEN 0 ELSE s.entries END AS entries, s.blocked AND NOT new AS blocked
FROM (SELECT s.*, n.rank = 3 AND n.session IS DISTINCT FROM s.session AS new FROM s JOIN n ON n.account = s.account AND n.i = s.i + 1) s JOIN n ON n.account = s.account AND n.i = s.i + 1)))))))
SELECT account, order_id, state, tm AS closed_at, net, equity, peak, worst AS max_drawdown FROM s WHERE state IS NOT NULL"""


@query(_SIMULATION)
def merged_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-13: orders, bars, exits and flatten times of each account in one order; breaches are liquidated at the next open, and what finds no price stays incomplete."""
    orders = _orders(spark, sf_dir)
    days = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))
    flattens = orders.select("account").distinct().select("account", days.alias("k")).select("account", (F.col("k") * (24 * H) + (_T0 + 21 * H)).alias("at"))
    events = accounts.account_events(orders, _bars(spark, sf_dir), flattens, 6 * H, 3 * H)
    return accounts.simulated(events, 10_000, 250, 3, 2_500, 40_000).select("account", F.col("order_id").cast("long").alias("order_id"), "state", "closed_at", "net", "equity", "peak", "max_drawdown")


@query(
    f"""WITH RECURSIVE {tables.TRADES}, c AS (SELECT instrument_id % 10 AS fold, event_at_ns // {H} AS entry, event_at_ns // {H} + 1 + event_id % 4 AS exit, event_id AS candidate, market, (event_id * 31 % 401 - 200) / 100.0::DOUBLE AS p, 0.5 + length(market) / 4.0 AS v FROM trades),
r AS (SELECT *, row_number() OVER (PARTITION BY fold, entry ORDER BY abs(p) / v DESC, length(market), candidate) AS k, dense_rank() OVER (PARTITION BY fold ORDER BY entry) AS i FROM c),
s AS (SELECT DISTINCT fold, 0::BIGINT AS i, -1::BIGINT AS until, false AS taken FROM r UNION ALL SELECT r.fold, r.i, CASE WHEN r.entry >= s.until THEN r.exit ELSE s.until END, r.entry >= s.until FROM s JOIN r ON r.fold = s.fold AND r.i = s.i + 1 AND r.k = 1)
SELECT r.fold, r.candidate, r.entry, CASE WHEN NOT s.taken THEN 'OVERLAP' WHEN r.k = 1 THEN 'SELECTED' ELSE 'SIMULTANEOUS' END AS state FROM r JOIN s ON s.fold = r.fold AND s.i = r.i"""
)
def one_contract_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-11: of the candidates of one time the one of the largest score over its training volatility, never two at once."""
    i = F.col("event_id")
    hour = clock.floor_div("event_at_ns", H)
    c = tables.trades(spark, sf_dir).select((F.col("instrument_id") % 10).alias("fold"), hour.alias("entry"), (hour + 1 + i % 4).alias("exit"), i.alias("candidate"), ((i * 31 % 401 - 200) / 100.0).alias("prediction"), (F.length("market") / 4.0 + 0.5).alias("volatility"), F.length("market").alias("order"))
    return accounts.one_contract(c, ["fold"])


@query(
    f"""WITH RECURSIVE {tables.TRADES}, c AS (SELECT instrument_id % 8 AS strategy, event_id AS candidate, event_at_ns // {24 * H} AS session, event_at_ns // {6 * H} % 4 AS checkpoint, length(market) AS market, CASE WHEN event_id % 11 <> 2 THEN (event_id * 29 % 97)::DOUBLE END AS score, event_id * 13 % 1100 AS risk, event_at_ns // 1000000000 AS entry,
  event_at_ns // 1000000000 + event_id * 97 % 30000 AS exit, CASE WHEN event_id % 13 <> 4 THEN event_id * 37 % 4001 - 2100 END AS net, event_at_ns // {24 * H} % 9 <> 5 AS complete FROM trades),
t AS (SELECT *, CASE WHEN score IS NULL THEN 'HURDLE_FAILURE' WHEN net IS NULL THEN 'MISSING_PRICE_PATH' WHEN risk > 1000 THEN 'RISK_CAP_REJECTION' END AS early FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy, session, checkpoint ORDER BY score DESC, market, candidate) AS k FROM t WHERE early IS NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry, market, candidate) AS i FROM r WHERE k = 1),
s AS (SELECT DISTINCT strategy, 0::BIGINT AS i, 0::BIGINT AS candidate, 0::BIGINT AS until, -1::BIGINT AS session, 0::BIGINT AS taken, 0::BIGINT AS day, 0::BIGINT AS equity, 0::BIGINT AS peak, '' AS state, 0::BIGINT AS net FROM w
UNION ALL SELECT strategy, i, candidate, CASE WHEN own IS NULL THEN until ELSE exit END, session, taken + (own IS NOT NULL)::INT, day + coalesce(own, 0), equity + coalesce(own, 0), greatest(peak, equity + coalesce(own, 0)), state, coalesce(own, 0)
FROM (SELECT *, CASE WHEN state = 'ADMITTED_TRADE' THEN net END AS own FROM (SELECT *, CASE WHEN NOT complete THEN 'MISSING_PRICE_PATH' WHEN entry < until THEN 'OVERLAP_ABSTENTION' WHEN day <= -1000 THEN 'DAILY_STOP_ABSTENTION' WHEN peak - equity >= 15000 THEN 'DRAWDOWN_ABSTENTION' WHEN taken >= 3 THEN 'ENTRY_CAP_ABSTENTION' ELSE 'ADMITTED_TRADE' END AS state FROM (
SELECT w.strategy, w.i, w.candidate, w.session, w.complete, w.entry, w.exit, w.net, s.until, s.equity, s.peak, CASE WHEN w.session = s.session THEN s.taken ELSE 0 END AS taken, CASE WHEN w.session = s.session THEN s.day ELSE 0 END AS day FROM s JOIN w ON w.strategy = s.strategy AND w.i = s.i + 1))))
SELECT strategy, candidate, state, net, equity FROM s WHERE i > 0 UNION ALL SELECT strategy, candidate, early, 0, 0 FROM t WHERE early IS NOT NULL UNION ALL SELECT strategy, candidate, 'CROSS_MARKET_RANKING_LOSS', 0, 0 FROM r WHERE k > 1"""
)
def strategy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-12: hurdle, price path, risk, rank across markets, then the account's own refusals; every opportunity ends in one state."""
    i = F.col("event_id")
    at = clock.floor_div("event_at_ns", clock.SECOND)
    c = tables.trades(spark, sf_dir).select(
        (F.col("instrument_id") % 8).alias("strategy"), i.alias("candidate"), clock.floor_div("event_at_ns", 24 * H).alias("session"), (clock.floor_div("event_at_ns", 6 * H) % 4).alias("checkpoint"), F.length("market").alias("market"),
        F.when(i % 11 != 2, (i * 29 % 97).cast("double")).alias("score"), (i * 13 % 1100).alias("risk"), at.alias("entry"), (at + i * 97 % 30000).alias("exit"), F.when(i % 13 != 4, i * 37 % 4001 - 2100).alias("net"), (clock.floor_div("event_at_ns", 24 * H) % 9 != 5).alias("complete"))
    found = accounts.strategy_path(c, ["strategy"], 1_000, 3, 1_000, 15_000)
    return found.withColumn("equity", F.coalesce("equity", F.lit(0)))


_ACTIONS = f"""{tables.TRADES}, a AS (SELECT instrument_id % 40 AS account, event_at_ns // {24 * H} AS session, count(*) AS n, sum(event_id * 37 % 4001 - 2050)::BIGINT AS net FROM trades GROUP BY 1, 2),
c AS (SELECT account, session, n % 4 <> 0 AS filled, net, greatest(net, 0) + n * 11 AS best, least(net, 0) - n * 17 AS worst, row_number() OVER (PARTITION BY account ORDER BY session) AS i FROM a)"""


@query(
    f"""WITH RECURSIVE {_ACTIONS}, s AS (SELECT DISTINCT account, 0::BIGINT AS i, 0::BIGINT AS session, '' AS state, 0::BIGINT AS net, 0::BIGINT AS equity, 0::BIGINT AS peak, 0::BIGINT AS dd, false AS halted FROM c
UNION ALL SELECT account, i, session, state, after - equity, after, greatest(peak, after), CASE WHEN ok THEN greatest(dd, peak - equity - worst, greatest(peak, after) - after) ELSE dd END, CASE WHEN ok THEN greatest(peak, after) - after >= 6000 ELSE halted END
FROM (SELECT *, CASE WHEN ok THEN equity + own ELSE equity END AS after, CASE WHEN ok THEN greatest(peak0, equity + best) ELSE peak0 END AS peak FROM (SELECT *, state = 'ADMITTED' AS ok FROM (
SELECT c.account, c.i, c.session, c.net AS own, c.best, c.worst, s.equity, s.peak AS peak0, s.dd, s.halted, CASE WHEN NOT c.filled THEN 'NO_FILL' WHEN s.halted THEN 'DRAWDOWN_BLOCKED' ELSE 'ADMITTED' END AS state FROM s JOIN c ON c.account = s.account AND c.i = s.i + 1))))
SELECT account, session, state, net, equity, dd AS max_drawdown FROM s WHERE i > 0"""
)
def pilot_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-15: sessions in order; the marks of each move the peak, the realised equity halts for good."""
    i, n, net = F.col("event_id"), F.col("n"), F.col("net")
    a = tables.trades(spark, sf_dir).groupBy((F.col("instrument_id") % 40).alias("account"), clock.floor_div("event_at_ns", 24 * H).alias("session")).agg(F.count("*").alias("n"), F.sum(i * 37 % 4001 - 2050).alias("net"))
    actions = a.select("account", "session", (n % 4 != 0).alias("filled"), "net", (F.greatest(net, F.lit(0)) + n * 11).alias("best"), (F.least(net, F.lit(0)) - n * 17).alias("worst"))
    return accounts.pilot(actions, ["account"], 6_000)


_PATHS = f"""{tables.TRADES}, c AS (SELECT instrument_id % 25 AS account, event_id AS path, event_at_ns // {24 * H} AS session, event_at_ns // 1000000000 AS entry, event_at_ns // 1000000000 + event_id * 97 % 20000 AS exit, event_id * 13 % 270 AS risk, event_id % 17 <> 3 AS ok,
  86400 - (event_at_ns // 1000000000) % 86400 AS to_roll, event_id % 6 = 0 AS ends, event_id * 37 % 4001 - 1900 AS gross, -(event_id * 53 % 2500) AS worst, event_id % 9 AS cost, event_id % 5 - 2 AS quantity, row_number() OVER (PARTITION BY instrument_id % 25 ORDER BY event_at_ns // 1000000000, event_id) AS i FROM trades)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("event_id"), clock.floor_div("event_at_ns", clock.SECOND)
    return tables.trades(spark, sf_dir).select(
        (F.col("instrument_id") % 25).alias("account"), i.alias("path"), i.alias("trade"), clock.floor_div("event_at_ns", 24 * H).alias("session"), s.alias("entry"), (s + i * 97 % 20000).alias("exit"), (i * 13 % 270).alias("risk"), (i % 17 != 3).alias("ok"),
        (F.lit(86400) - s % 86400).alias("to_roll"), (i % 6 == 0).alias("ends_session"), (i * 37 % 4001 - 1900).alias("gross"), (-(i * 53 % 2500)).alias("worst"), (i % 9).alias("cost"), (i % 5 - 2).alias("quantity"))


@query(
    f"""WITH RECURSIVE {_PATHS}, s AS (SELECT DISTINCT account, 0::BIGINT AS i, 0::BIGINT AS path, 0::BIGINT AS until, -1::BIGINT AS session, 0::BIGINT AS taken, 0::BIGINT AS day, false AS locked, 0::BIGINT AS equity, 0::BIGINT AS peak, false AS halted, '' AS state, 0::BIGINT AS net FROM c
UNION ALL SELECT account, i, path, CASE WHEN ok THEN exit ELSE until END, session, taken + ok::INT, day + own, locked OR (ok AND by_day), equity + own, CASE WHEN ok THEN greatest(peak, equity + own) ELSE peak END, halted OR (ok AND by_peak), CASE WHEN NOT ok THEN code WHEN by_day OR by_peak THEN 'FLATTENED' ELSE 'ACCEPTED' END, own
FROM (SELECT *, CASE WHEN NOT ok THEN 0 WHEN by_day OR by_peak THEN least(gross - cost, low) ELSE gross - cost END AS own FROM (
SELECT *, code = '' AS ok, day + low <= -2500 AS by_day, peak - (equity + least(low, 0)) >= 20000 AS by_peak FROM (
SELECT *, CASE WHEN risk > 250 OR NOT sound OR to_roll < 3600 THEN 'REJECTED' WHEN entry < until OR taken >= 3 OR locked OR halted THEN 'SKIPPED' WHEN exit - entry > 15000 AND NOT ends THEN 'BYPASS' ELSE '' END AS code FROM (
SELECT c.account, c.i, c.path, c.entry, c.exit, c.risk, c.ok AS sound, c.to_roll, c.ends, c.gross, c.cost, c.worst - c.cost AS low, s.until, c.session, s.equity, s.peak, s.halted,
  CASE WHEN c.session = s.session THEN s.taken ELSE 0 END AS taken, CASE WHEN c.session = s.session THEN s.day ELSE 0 END AS day, c.session = s.session AND s.locked AS locked FROM s JOIN c ON c.account = s.account AND c.i = s.i + 1)))))
SELECT account, path, state, net, equity FROM s WHERE i > 0"""
)
def risk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-19: admission, schedule, holding times, circuits, and the forced flatten at the worse result."""
    return accounts.audited_paths(_paths(spark, sf_dir), ["account"], 250, 3, 2_500, 20_000, 15_000, 3_600)


@query(
    f"""WITH RECURSIVE {_PATHS}, s AS (SELECT DISTINCT account, 0::BIGINT AS i, 0::BIGINT AS trade, -1::BIGINT AS session, 0::BIGINT AS day, 0::BIGINT AS equity, 0::BIGINT AS peak, '' AS state, 0::BIGINT AS net FROM c
UNION ALL SELECT account, i, path, session, day + own, equity + own, greatest(peak, equity + own), CASE WHEN go THEN 'TRADED' ELSE 'SKIPPED' END, own FROM (SELECT *, CASE WHEN go THEN gross - cost * abs(quantity) ELSE 0 END AS own FROM (SELECT *, day > -1500 AND peak - equity < 9000 AS go FROM (
SELECT c.*, s.equity, s.peak, CASE WHEN c.session = s.session THEN s.day ELSE 0 END AS day FROM s JOIN c ON c.account = s.account AND c.i = s.i + 1))))
SELECT account, trade, state, net, equity FROM s WHERE i > 0"""
)
def stopped_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-18: closed trades under one cost scenario, with both stops."""
    return accounts.scenario_trades(_paths(spark, sf_dir), ["account"], 1_500, 9_000)
