"""Queries on window features, labels, folds, models, schedules, accounts and inference."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import accounts, folds, inference, labels, ridge, windows
from . import tables
from .registry import query

H = clock.HOUR
#: One bar per market and hour: a week's roll may leave two contracts in an hour, of which the later stays.
ONE = f"""{tables.bars_sql()}, one AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY market, event_at_ns ORDER BY contract DESC) = 1)"""
W = f"WITH {ONE}"
TR = """t AS (SELECT *, CASE WHEN was IS NULL THEN high_nano - low_nano ELSE greatest(high_nano - low_nano, abs(high_nano - was), abs(low_nano - was)) END AS tr
  FROM (SELECT *, lag(close_nano) OVER (PARTITION BY market ORDER BY event_at_ns) AS was FROM one))"""


def one_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("market", "event_at_ns").orderBy(F.desc("contract")))
    return tables.bars(spark, sf_dir).withColumn("_n", n).where("_n = 1").drop("_n")


@query(f"""{W}, {TR} SELECT market, event_at_ns, tr AS true_range, round(avg(tr) OVER (PARTITION BY market ORDER BY event_at_ns ROWS 19 PRECEDING), 3) AS atr FROM t QUALIFY count(*) OVER (PARTITION BY market ORDER BY event_at_ns ROWS 19 PRECEDING) = 20""")
def true_range_atr20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01: true ranges and their mean over the last 20 bars."""
    a = windows.mean_atr(one_bars(spark, sf_dir), ["market"], 20).where("atr is not null")
    return a.select("market", "event_at_ns", "true_range", F.round("atr", 3).alias("atr"))


@query(
    f"""{W}, g AS (SELECT *, event_at_ns - {H} * row_number() OVER (PARTITION BY market ORDER BY event_at_ns) AS k FROM one), r AS (SELECT *, lag(close_nano) OVER (PARTITION BY market, k ORDER BY event_at_ns) AS was FROM g),
t AS (SELECT market, k, event_at_ns, CASE WHEN was IS NULL THEN high_nano - low_nano ELSE greatest(high_nano - low_nano, abs(high_nano - was), abs(low_nano - was)) END::DOUBLE AS tr FROM r),
l AS (SELECT market, max(event_at_ns) AS event_at_ns, count(*) AS bars, list(tr ORDER BY event_at_ns) AS trs FROM t GROUP BY market, k)
SELECT market, event_at_ns, bars, round(list_reduce(list_prepend(list_avg(trs[1:5]), trs[6:]), lambda a, x: (a * 4 + x) / 5), 1) AS atr FROM l WHERE bars >= 5"""
)
def wilder_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-02: Wilder's recursion, seeded at the start of each run."""
    a = windows.wilder_atr(one_bars(spark, sf_dir), ["market"], 5, H).where("bars >= 5")
    return a.select("market", "event_at_ns", "bars", F.round("atr", 1).alias("atr"))


_F = ("return_1", "return_5", "return_20", "range_fraction", "realised_volatility", "log_volume", "volume_z", "sine", "cosine")


@query(
    f"""{W}, {TR}, b AS (SELECT *, ln(close_nano / lag(close_nano) OVER w) AS lr, ln(1 + volume) AS lv, lag(event_at_ns, 7) OVER w AS back, close_nano / lag(close_nano, 1) OVER w - 1 AS r1, close_nano / lag(close_nano, 5) OVER w - 1 AS r5, (make_timestamp(event_at_ns // 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') AS here FROM t WINDOW w AS (PARTITION BY market ORDER BY event_at_ns)),
f AS (SELECT *, stddev_pop(lr) OVER v AS rv, stddev_pop(lv) OVER u AS dv, avg(lv) OVER u AS mv, ((hour(here) * 60 + minute(here) - 1020 + 1440) % 1440) AS m FROM b WINDOW v AS (PARTITION BY market ORDER BY event_at_ns ROWS 19 PRECEDING), u AS (PARTITION BY market ORDER BY event_at_ns ROWS 6 PRECEDING))
SELECT market, event_at_ns, round(r1, 6) AS return_1, round(r5, 6) AS return_5, round((high_nano - low_nano) / open_nano, 6) AS range_fraction, round(rv, 6) AS realised_volatility, round(lv, 6) AS log_volume, round(CASE WHEN dv > 0 THEN (lv - mv) / dv ELSE 0 END, 6) AS volume_z, round(sin(2 * pi() * m / 1440), 6) + 0.0 AS sine, round(cos(2 * pi() * m / 1440), 6) + 0.0 AS cosine FROM f WHERE event_at_ns - back = {7 * H}"""
)
def causal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-04, I-12: the feature vector over the last eight contiguous bars."""
    f = windows.features(one_bars(spark, sf_dir), ["market"], H, 8)
    return f.select("market", "event_at_ns", *((F.round(c, 6) + 0.0).alias(c) for c in _F if c != "return_20"))


@query(
    f"""{W}, e AS (SELECT market, event_at_ns, lag(event_at_ns, 4) OVER (PARTITION BY market ORDER BY event_at_ns) AS first_ns FROM one), d AS (SELECT DISTINCT market, event_at_ns // {6 * H} * {6 * H} + 1 AS decided_ns FROM one)
SELECT d.market, d.decided_ns, CASE WHEN e.first_ns IS NULL THEN 'TOO_FEW_BARS' WHEN e.event_at_ns - e.first_ns > {5 * H} THEN 'SPAN_TOO_LONG' WHEN d.decided_ns - e.event_at_ns > {H} THEN 'STALE' ELSE 'COMPLETE' END AS state FROM d ASOF LEFT JOIN e ON d.market = e.market AND d.decided_ns >= e.event_at_ns"""
)
def reported_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-05, Q-15, Q-17: the last reported bars, gaps allowed, by span and age."""
    b = one_bars(spark, sf_dir)
    d = b.select("market", (clock.floor_to("event_at_ns", 6 * H) + 1).alias("decided_ns")).distinct()
    return windows.reported(b, d, ["market"], "decided_ns", 5, 5 * H, H).select("market", "decided_ns", "state")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, (round(o_totalprice * 100)::BIGINT % 20001) - 10000 AS pnl FROM orders), e AS (SELECT *, sum(pnl) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS equity FROM p),
k AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS peak FROM e) SELECT o_custkey, o_orderkey, equity::BIGINT AS equity, peak::BIGINT AS peak, (peak - equity)::BIGINT AS drawdown FROM k""")
def running_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-06."""
    return windows.drawdown(_pnl(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "pnl").drop("pnl")


def _pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("long") % 20001 - 10000).alias("pnl"))


_PNL = "p AS (SELECT o_custkey, o_orderkey, (round(o_totalprice * 100)::BIGINT % 20001) - 10000 AS pnl FROM orders)"
_DD = f"""{_PNL}, e AS (SELECT *, sum(pnl) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS equity FROM p), k AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) - equity AS dd FROM e)"""


@query(f"""WITH {_DD} SELECT o_custkey, count(*) AS trades, sum(pnl)::BIGINT AS net, round(avg((pnl > 0)::INT), 6) AS hit_rate, round(coalesce(avg(pnl) / nullif(stddev_pop(pnl), 0), 0), 6) AS sharpe, round(coalesce(avg(pnl) / nullif(sqrt(avg(least(pnl, 0)::DOUBLE * least(pnl, 0))), 0), 0), 6) AS sortino, max(dd)::BIGINT AS max_drawdown FROM k GROUP BY 1""")
def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-11: per period, population deviation, 0 where it is 0."""
    m = windows.metrics(_pnl(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "pnl")
    return m.withColumns({c: F.round(c, 6) for c in ("hit_rate", "sharpe", "sortino")})


@query(f"""WITH {_DD}, r AS (SELECT *, pnl / 100000.0 AS r FROM k) SELECT o_custkey, count(*) AS trades, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 6) AS sharpe FROM r GROUP BY 1 HAVING count(*) > 1""")
def annualised_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-13: on the capital, sample deviation, null where it is 0."""
    m = windows.metrics(_pnl(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "pnl", 252, 100000.0)
    return m.where("trades > 1").select("o_custkey", "trades", F.round("sharpe", 6).alias("sharpe"))


@query(f"""{W}, s AS (SELECT market, session, arg_min(open_nano, event_at_ns) AS a, arg_max(close_nano, event_at_ns) AS b FROM one GROUP BY 1, 2) SELECT market, session, coalesce(lag(sign(b - a)) OVER (PARTITION BY market ORDER BY session), 0)::INTEGER AS prior_direction FROM s""")
def prior_session_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-08, M-10."""
    s = one_bars(spark, sf_dir).groupBy("market", "session").agg(F.min_by("open_nano", "event_at_ns").alias("a"), F.max_by("close_nano", "event_at_ns").alias("b"))
    return windows.prior_direction(s, ["market"], "session", "a", "b").select("market", "session", F.coalesce("prior_direction", F.lit(0)).alias("prior_direction"))


@query("""WITH s AS (SELECT event_type AS market, CAST(ts AS DATE)::VARCHAR AS session, hour(ts) // 6 AS checkpoint, avg(value) AS score FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY session, checkpoint ORDER BY score DESC, market) AS n FROM s)
SELECT market, session, checkpoint, CASE WHEN n = 1 THEN 'SELECTED' ELSE 'CROSS_MARKET_RANKING_LOSS' END AS state FROM r""")
def rank_per_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-15, Q-07: one winner per session and checkpoint, chosen before any outcome is seen."""
    s = tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("market"), F.to_date("ts").cast("string").alias("session"), F.floor(F.hour("ts") / 6).cast("long").alias("checkpoint")).agg(F.avg("value").alias("score"))
    n = F.row_number().over(Window.partitionBy("session", "checkpoint").orderBy(F.desc("score"), "market"))
    return s.withColumn("n", n).select("market", "session", "checkpoint", F.when(F.col("n") == 1, "SELECTED").otherwise("CROSS_MARKET_RANKING_LOSS").alias("state"))


_GRID = f"""d AS (SELECT market, event_at_ns AS decided_ns, contract, unnest(range(1, 6)) AS k FROM one WHERE volume >= 2), p AS (SELECT d.market, d.decided_ns, d.k, b.open_nano, CASE WHEN b.open_nano IS NULL OR b.volume < 2 THEN 'MISSING_SOURCE' WHEN b.contract <> d.contract THEN 'ROLL_UNRESOLVED' WHEN b.open_nano <= 0 THEN 'MISSING_SOURCE' END AS code, b.open_nano IS NOT NULL AND b.contract <> d.contract AS rolled
  FROM d LEFT JOIN one b ON b.market = d.market AND b.event_at_ns = d.decided_ns + d.k * {H})"""


def _decisions(b: DataFrame) -> DataFrame:
    return b.where("volume >= 2").select("market", F.col("event_at_ns").alias("decided_ns"), "contract")


def _with_disposition(b: DataFrame) -> DataFrame:
    return b.withColumn("disposition", F.when(F.col("volume") >= 2, "ELIGIBLE").otherwise("THIN"))


@query(f"""{W}, {_GRID}, g AS (SELECT market, decided_ns, coalesce(arg_min(code, k) FILTER (code IS NOT NULL), 'MATURED') AS status, max(open_nano) FILTER (k = 1) AS a, max(open_nano) FILTER (k = 5) AS b FROM p GROUP BY 1, 2) SELECT market, decided_ns, status, round(CASE WHEN status = 'MATURED' THEN b / a - 1 END, 9) AS outcome FROM g""")
def grid_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-17, K-09: the label path on an exact time grid; the first failing step decides."""
    b = one_bars(spark, sf_dir)
    out = labels.grid_outcome(_decisions(b), _with_disposition(b), ["market"], "decided_ns", ["contract"], H, 1, 5)
    return out.select("market", "decided_ns", "status", F.round("outcome", 9).alias("outcome"))


@query(f"""{W}, {_GRID}, g AS (SELECT market, decided_ns, CASE WHEN bool_or(rolled) THEN 'ROLL_UNRESOLVED' ELSE coalesce(arg_min(code, k) FILTER (code IS NOT NULL), 'MATURED') END AS status FROM p GROUP BY 1, 2) SELECT status, count(*) AS n FROM g GROUP BY 1""")
def grid_outcome_roll_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-18: the variant in which a roll outranks missing bars."""
    b = one_bars(spark, sf_dir)
    return labels.grid_outcome(_decisions(b), _with_disposition(b), ["market"], "decided_ns", ["contract"], H, 1, 5, roll_first=True).groupBy("status").agg(F.count("*").alias("n"))


_BRACKET = f"""a0 AS (SELECT market, event_at_ns AS decided_ns, round(avg(tr) OVER (PARTITION BY market ORDER BY event_at_ns ROWS 4 PRECEDING)) AS atr FROM t), b0 AS (SELECT *, unnest([1, -1]) AS d FROM a0),
k0 AS (SELECT market, decided_ns, d, atr, unnest(range(1, 7)) AS k FROM b0), w0 AS (SELECT k0.*, o.open_nano AS o, o.high_nano AS h, o.low_nano AS l, o.close_nano AS c, o.contract FROM k0 LEFT JOIN one o ON o.market = k0.market AND o.event_at_ns = k0.decided_ns + k0.k * {H}),
e0 AS (SELECT market, decided_ns, d, o AS entry, contract AS own FROM w0 WHERE k = 1), x AS (SELECT w0.*, entry, own, entry - d * ceil(atr * 1.5)::BIGINT AS stop, entry + d * (ceil(atr * 1.5)::BIGINT * 2) AS target FROM w0 JOIN e0 USING (market, decided_ns, d)),
v AS (SELECT *, CASE WHEN entry IS NULL OR o IS NULL THEN 'ABSTAIN_GAP' WHEN contract <> own THEN 'ROLL_EXIT' WHEN k > 1 AND (o - stop) * d <= 0 THEN 'STOP_GAP' WHEN k > 1 AND (o - target) * d >= 0 THEN 'TARGET_GAP' WHEN (CASE WHEN d > 0 THEN l ELSE h END - stop) * d <= 0 THEN 'STOP' WHEN (CASE WHEN d > 0 THEN h ELSE l END - target) * d >= 0 THEN 'TARGET' WHEN k = 6 THEN 'TIMEOUT' END AS what FROM x)"""


@query(f"""{W}, {TR}, {_BRACKET}, f AS (SELECT market, decided_ns, d, min(k) FILTER (what IS NOT NULL) AS exit_step, arg_min(what, k) FILTER (what IS NOT NULL) AS exit_reason FROM v GROUP BY 1, 2, 3), y AS (SELECT f.*, v.entry, CASE exit_reason WHEN 'STOP_GAP' THEN v.o WHEN 'TARGET_GAP' THEN v.o WHEN 'STOP' THEN v.stop WHEN 'TARGET' THEN v.target WHEN 'TIMEOUT' THEN v.c WHEN 'ROLL_EXIT' THEN p.c END AS leave
  FROM f JOIN v ON v.market = f.market AND v.decided_ns = f.decided_ns AND v.d = f.d AND v.k = f.exit_step LEFT JOIN v p ON p.market = f.market AND p.decided_ns = f.decided_ns AND p.d = f.d AND p.k = f.exit_step - 1)
SELECT market, decided_ns, d AS direction, exit_step, exit_reason, coalesce(d * (leave - entry), 0) AS gross_nano FROM y""")
def bracket_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-01: event-ordered barriers in both directions."""
    b = one_bars(spark, sf_dir)
    w = Window.partitionBy("market").orderBy("event_at_ns")
    d = b.withColumn("tr", windows.true_range(w)).select("market", F.col("event_at_ns").alias("decided_ns"), F.round(F.avg("tr").over(w.rowsBetween(-4, 0))).alias("atr"))
    d = d.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    out = labels.bracket(d, b, ["market"], "decided_ns", ["contract"], H, 6)
    return out.select("market", "decided_ns", "direction", "exit_step", "exit_reason", F.coalesce("gross_nano", F.lit(0).cast("long")).alias("gross_nano"))


@query(f"""{W}, k0 AS (SELECT market, event_at_ns AS decided_ns, close_nano * 9 // 10 AS lim, unnest(range(1, 9)) AS k FROM one), w0 AS (SELECT k0.*, o.low_nano AS l, o.close_nano AS c FROM k0 LEFT JOIN one o ON o.market = k0.market AND o.event_at_ns = k0.decided_ns + k0.k * {H}),
f AS (SELECT market, decided_ns, lim, min(k) FILTER (k <= 4 AND l <= lim - 1000000) AS fill FROM w0 GROUP BY 1, 2, 3), x AS (SELECT f.market, f.decided_ns, f.lim, f.fill, min(w0.k) AS leave, arg_min(w0.c, w0.k) AS c FROM f LEFT JOIN w0 ON w0.market = f.market AND w0.decided_ns = f.decided_ns AND w0.c IS NOT NULL AND w0.k BETWEEN f.fill + 2 AND f.fill + 4 GROUP BY 1, 2, 3, 4)
SELECT market, decided_ns, CASE WHEN fill IS NULL THEN 'NOT_FILLED' WHEN leave IS NULL THEN 'FILLED_OPEN' ELSE 'FILLED_CLOSED' END AS state, coalesce(CASE WHEN fill IS NOT NULL THEN c - lim END, 0) AS gross_nano FROM x""")
def limit_entry_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-04, K-05, K-06: a limit order fills only where the price goes through it."""
    b = one_bars(spark, sf_dir)
    d = b.select("market", F.col("event_at_ns").alias("decided_ns"), F.lit(1).alias("direction"), clock.floor_div(F.col("close_nano") * 9, 10).alias("limit_nano"))
    out = labels.limit_path(d, b, ["market"], "decided_ns", H, 1_000_000, 4, 2)
    return out.select("market", "decided_ns", "state", F.coalesce("gross_nano", F.lit(0).cast("long")).alias("gross_nano"))


@query(f"""{W}, d AS (SELECT DISTINCT market, event_at_ns // {6 * H} * {6 * H} AS decided_ns FROM one), h AS (SELECT d.market, d.decided_ns, arg_min(b.event_at_ns, b.available_at_ns) AS trigger_ns FROM d LEFT JOIN one b ON b.market = d.market AND b.available_at_ns > d.decided_ns AND b.available_at_ns <= d.decided_ns + {3 * H} AND b.event_at_ns >= d.decided_ns GROUP BY 1, 2)
SELECT market, decided_ns, CASE WHEN trigger_ns IS NULL THEN 'NO_TRIGGER' ELSE 'TRIGGERED' END AS state, coalesce(trigger_ns, -1) AS trigger_ns FROM h""")
def first_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-03: the first bar that becomes available after a decision."""
    b = one_bars(spark, sf_dir)
    d = b.select("market", clock.floor_to("event_at_ns", 6 * H).alias("decided_ns")).distinct()
    out = labels.first_trigger(d, b, ["market"], "decided_ns", 3 * H)
    return out.select("market", "decided_ns", "state", F.coalesce("trigger_ns", F.lit(-1).cast("long")).alias("trigger_ns"))


_SESSIONS = f"""{W}, n AS (SELECT market, session, row_number() OVER (PARTITION BY market ORDER BY session)::INTEGER AS session_no FROM (SELECT DISTINCT market, session FROM one))"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.numbered(one_bars(spark, sf_dir), ["market"], "session")


@query(f"""{_SESSIONS}, f AS (SELECT n.*, f::INTEGER AS fold, CASE WHEN session_no <= 8 + 4 * f THEN 'FIT' WHEN session_no = 9 + 4 * f THEN 'EMBARGO' WHEN session_no <= 13 + 4 * f THEN 'EVALUATE' END AS role FROM n, range(0, 4) t(f)) SELECT market, session, session_no, fold, role FROM f WHERE role IS NOT NULL""")
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-16, J-11, Q-18: expanding folds with an embargo."""
    return folds.expanding(_sessions(spark, sf_dir), 4, 8, 4, 4)


@query(f"""{_SESSIONS} SELECT *, ntile(8) OVER (PARTITION BY market ORDER BY session_no)::INTEGER AS fold FROM n""")
def equal_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-17."""
    return folds.equal(_sessions(spark, sf_dir), ["market"], 8)


@query("""WITH s AS (SELECT event_id AS sample, event_id AS decision, event_id + 1 AS a, event_id + 6 AS b, event_id + 8 AS known FROM events), w AS (SELECT f AS fold, 300 + 150 * f AS s0, 400 + 150 * f AS e0 FROM range(0, 4) t(f))
SELECT w.fold, s.sample FROM s, w WHERE s.decision < s0 - 5 AND s.known < s0 AND NOT (s.a < e0 AND s.b > s0) AND NOT (s.decision >= e0 AND s.decision < e0 + 5)""")
def purged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-12: strictly past, purged and embargoed training samples."""
    i = F.col("event_id")
    s = tables.table(spark, sf_dir, "events").select(i.alias("sample"), i.alias("decision"), (i + 1).alias("label_start"), (i + 6).alias("label_end"), (i + 8).alias("label_known"))
    w = spark.range(4).select(F.col("id").alias("fold"), (300 + 150 * F.col("id")).alias("start"), (400 + 150 * F.col("id")).alias("end"))
    return folds.purged(s, w, 5)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') < count(*) / 5 AS ok FROM events GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY day)::INTEGER AS session_no, ok FROM d)
SELECT a.session_no AS first_session, count(*) FILTER (b.ok AND b.session_no < a.session_no + 10) AS training, count(*) FILTER (b.ok AND b.session_no >= a.session_no + 11) AS evaluation FROM n a JOIN n b ON b.session_no BETWEEN a.session_no AND a.session_no + 14 GROUP BY 1 HAVING count(*) = 15""")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-28: every sliding window of training, embargo and evaluation sessions."""
    d = tables.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") < F.count("*") / 5).alias("ok"))
    n = d.withColumn("session_no", F.row_number().over(Window.orderBy("day")))
    return folds.best_training_windows(n, "ok", 10, 1, 4)


_X = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * l_quantity), 3) AS xx, round(sum(l_quantity * l_discount), 3) AS xz, round(sum(l_quantity * l_extendedprice / 1000), 1) AS xy FROM lineitem GROUP BY 1""")
def gram_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-04, E-23: sufficient statistics in one pass."""
    g = ridge.gram(_lines(spark, sf_dir), ["l_returnflag"], _X, ["price"])
    return g.select("l_returnflag", "n", F.round("s_l_quantity__l_quantity", 3).alias("xx"), F.round("s_l_quantity__l_discount", 3).alias("xz"), F.round("s_l_quantity__price", 1).alias("xy"))


def _solved(keys: str, source: str, x: list[str], name: str = "", raw: bool = False) -> str:
    """Ridge with penalty 1, standardised or of raw features, by Cramer's rule for two or three of them: w0 and so on, intercept, mse."""
    n = len(x)
    one = [*x, "y"]
    means = ", ".join(f"avg({c}) AS m_{c}" for c in one)
    sums = ", ".join(f"sum(({a} - m_{a}) * ({b} - m_{b})) AS c_{a}_{b}" for i, a in enumerate(one) for b in one[i:])
    c = lambda a, b: f"c_{min(a, b, key=one.index)}_{max(a, b, key=one.index)}"
    dev = ", ".join(f"1 AS d_{a}" if raw else f"CASE WHEN c_{a}_{a} > 1e-12 THEN sqrt(c_{a}_{a} / n) ELSE 1 END AS d_{a}" for a in x)
    z = ", ".join([*(f"{c(a, b)} / (d_{a} * d_{b}) + {int(a == b)} AS z_{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x)), *(f"{c(a, 'y')} / d_{a} AS r_{i}" for i, a in enumerate(x))])

    def det(rows: list[list[str]]) -> str:
        if len(rows) == 1:
            return rows[0][0]
        return " ".join(f"{'-' if j % 2 else '+'} {rows[0][j]} * ({det([r[:j] + r[j + 1:] for r in rows[1:]])})" for j in range(len(rows)))

    grid = [[f"z_{i}{j}" for j in range(n)] for i in range(n)]
    w = ", ".join(f"({det([[f'r_{i}' if j == k else grid[i][j] for j in range(n)] for i in range(n)])}) / ({det(grid)}) / d_{a} AS w{k}" for k, a in enumerate(x))
    rest = f"c_y_y - 2 * ({' + '.join(f'w{i} * {c(a, chr(121))}' for i, a in enumerate(x))}) + {' + '.join(f'w{i} * w{j} * {c(a, b)}' for i, a in enumerate(x) for j, b in enumerate(x))}"
    return f"""{name}a0 AS (SELECT {keys}, {means} FROM {source} GROUP BY {keys}), {name}a1 AS (SELECT {keys}, count(*) AS n, {', '.join(f'any_value(m_{c_}) AS m_{c_}' for c_ in one)}, {sums} FROM {source} JOIN {name}a0 USING ({keys}) GROUP BY {keys}), {name}a2 AS (SELECT *, {dev} FROM {name}a1), {name}a3 AS (SELECT *, {z} FROM {name}a2), {name}a4 AS (SELECT *, {w} FROM {name}a3),
{name}m AS (SELECT *, m_y - ({' + '.join(f'w{i} * m_{a}' for i, a in enumerate(x))}) AS intercept, greatest({rest}, 0) / n AS mse FROM {name}a4 WHERE n > {n})"""


@query(
    f"""WITH i AS (SELECT l_returnflag, l_linestatus, l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_extendedprice / 1000 AS y FROM lineitem), {_solved("l_returnflag, l_linestatus", "i", ["x0", "x1", "x2"])}
SELECT l_returnflag, l_linestatus, 'price' AS target, n, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(intercept, 6) AS intercept, round(mse, 4) AS mse FROM m"""
)
def ridge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01, J-02, Q-04, Q-19: ridge per group from its Gram sums."""
    m = ridge.fit(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus"], _X, ["price"], 1.0)
    return m.select("l_returnflag", "l_linestatus", "target", "n", *(F.round(F.col("weights")[i], 6).alias(f"w{i}") for i in range(3)), F.round("intercept", 6).alias("intercept"), F.round("mse", 4).alias("mse"))


@query("""WITH m AS (SELECT l_returnflag, regr_slope(l_extendedprice / 1000, l_quantity) AS w, regr_intercept(l_extendedprice / 1000, l_quantity) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, round(b + w * l_quantity, 5) AS prediction FROM lineitem JOIN m USING (l_returnflag)""")
def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07, J-13: a model without penalty on one feature is a regression line."""
    rows = _lines(spark, sf_dir)
    m = ridge.fit(rows, ["l_returnflag"], ["l_quantity"], ["price"], 0.0)
    return ridge.predicted(rows, m, ["l_returnflag"], ["l_quantity"], "price").select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 5).alias("prediction"))


@query("""SELECT o_orderpriority, quantile_disc(abs(o_totalprice - 200000), 0.6) AS threshold FROM orders GROUP BY 1""")
def neutral_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-08."""
    o = tables.table(spark, sf_dir, "orders").withColumn("prediction", F.col("o_totalprice") - 200000)
    return ridge.neutral_threshold(o, ["o_orderpriority"], "prediction")


@query("""WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS location, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, n, round(location, 6) AS location, round(1.4826 * median(abs(o_totalprice - location)), 4) AS scale FROM orders JOIN m USING (o_orderpriority) GROUP BY 1, 2, 3""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-19."""
    r = ridge.robust_scale(tables.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 10)
    return r.select("o_orderpriority", "n", F.round("location", 6).alias("location"), F.round("scale", 4).alias("scale"))


@query("""SELECT o_orderpriority, round(stddev_pop(o_totalprice), 4) AS volatility, round(avg((o_totalprice - 200000) ** 2), 0) AS mse, round(corr(o_totalprice, o_custkey), 6) AS corr, round(avg((sign(o_totalprice - 200000) = sign(o_custkey - 500))::INT), 6) AS directional FROM orders GROUP BY 1 HAVING count(*) >= 2""")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-17, E-22."""
    x = F.col("o_totalprice") - 200000
    o = tables.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.stddev_pop("o_totalprice"), 4).alias("volatility"), F.round(F.avg(x * x), 0).alias("mse"), F.round(F.corr("o_totalprice", "o_custkey"), 6).alias("corr"),
        F.round(F.avg((F.signum(x) == F.signum(F.col("o_custkey") - 500)).cast("double")), 6).alias("directional"))
    return o.where("n >= 2").drop("n")


@query("""WITH m AS (SELECT l_returnflag AS market, l_linenumber AS fold, avg(l_discount - 0.05) AS a FROM lineitem GROUP BY 1, 2), f AS (SELECT l_returnflag AS market, avg(l_tax - 0.04) AS b FROM lineitem GROUP BY 1) SELECT market, fold, sign(CASE WHEN fold % 3 = 0 THEN b ELSE a END)::INTEGER AS side FROM m JOIN f USING (market)""")
def fold_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-15: a cell's direction, with the market's where the cell has none."""
    i = tables.table(spark, sf_dir, "lineitem")
    cell = i.groupBy(F.col("l_returnflag").alias("market"), F.col("l_linenumber").alias("fold")).agg(F.avg(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") - 0.05)).alias("a"))
    market = i.groupBy(F.col("l_returnflag").alias("market")).agg(F.avg(F.col("l_tax") - 0.04).alias("b"))
    return cell.join(market, "market").select("market", "fold", F.signum(F.coalesce("a", "b")).cast("int").alias("side"))


@query("""WITH f AS (SELECT l_returnflag AS market, l_linenumber AS fold, avg(l_discount) AS x, count(*) AS w FROM lineitem GROUP BY 1, 2) SELECT market, fold, round((sum(w * x) OVER p - w * x) / (sum(w) OVER p - w), 9) AS without FROM f WINDOW p AS (PARTITION BY market)""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-12: weighted means without each fold."""
    f = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("market"), F.col("l_linenumber").alias("fold")).agg(F.avg("l_discount").alias("x"), F.count("*").alias("w"))
    p = Window.partitionBy("market")
    wx = F.col("w") * F.col("x")
    return f.select("market", "fold", F.round((F.sum(wx).over(p) - wx) / (F.sum("w").over(p) - F.col("w")), 9).alias("without"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.trades(spark, sf_dir)
    cents = F.round(F.col("value") * 100).cast("long")
    return t.select("market", F.col("event_id").alias("candidate"), clock.utc_date("event_at_ns").cast("string").alias("session"), clock.floor_div("event_at_ns", clock.SECOND).alias("entry"), (clock.floor_div("event_at_ns", clock.SECOND) + 1800 + F.col("event_id") % 3600).alias("exit"), (cents % 30001).alias("risk"), (cents % 40001 - 9000).alias("pnl"))


_SCHEDULE = f"""WITH RECURSIVE {tables.TRADES}, c0 AS (SELECT market, event_id AS candidate, (make_timestamp(event_at_ns // 1000)::DATE)::VARCHAR AS session, event_at_ns // 1000000000 AS entry, event_at_ns // 1000000000 + 1800 + event_id % 3600 AS exit, round(value * 100)::BIGINT AS cents FROM trades),
c AS (SELECT *, KEYS AS k, cents % 30001 AS risk, cents % 40001 - 9000 AS pnl, row_number() OVER (PARTITION BY KEYS ORDER BY entry, candidate) AS i FROM c0),
s AS (SELECT DISTINCT k, 0::BIGINT AS i, -4611686018427387904 AS free, '' AS session, 0::BIGINT AS taken, 0::BIGINT AS day, 0::BIGINT AS equity, 0::BIGINT AS peak, false AS halted, '' AS state FROM c UNION ALL
SELECT k, i, CASE WHEN ok THEN exit ELSE free END, session, taken + ok::INT, day + ok::INT * pnl, equity + ok::INT * pnl, greatest(peak, equity + ok::INT * pnl), CASE WHEN ok THEN greatest(peak, equity + pnl) - equity - pnl >= 100000 ELSE halted END, state FROM (SELECT *, state = 'ADMITTED' AS ok FROM (SELECT *,
  CASE WHEN risk > 25000 THEN 'RISK_CAP' WHEN entry < free THEN 'OVERLAP' WHEN taken >= 3 THEN 'SESSION_CAP' WHEN day <= -10000 THEN 'DAILY_STOP' WHEN halted THEN 'DRAWDOWN' ELSE 'ADMITTED' END AS state FROM (
  SELECT c.k, c.i, c.session, c.entry, c.exit, c.risk, c.pnl, s.free, s.equity, s.peak, s.halted, CASE WHEN c.session = s.session THEN s.taken ELSE 0 END AS taken, CASE WHEN c.session = s.session THEN s.day ELSE 0 END AS day FROM s JOIN c ON c.k = s.k AND c.i = s.i + 1))))
SELECT c.market, COLUMNS c.candidate, c.session, c.entry, c.pnl, s.state FROM s JOIN c ON c.k = s.k AND c.i = s.i"""


@query(_SCHEDULE.replace("KEYS", "market").replace("COLUMNS ", ""))
def portfolio_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10, Q-20: sequential admission of candidates."""
    return accounts.schedule(_candidates(spark, sf_dir), ["market"], 25_000, 3, 10_000, 100_000)


@query(_SCHEDULE.replace("KEYS", "market || substr(session, 1, 7)").replace("COLUMNS ", "substr(c.session, 1, 7) AS segment, "))
def segmented_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-14, Q-09: the state starts anew in each segment."""
    c = _candidates(spark, sf_dir).withColumn("segment", F.substring("session", 1, 7))
    return accounts.schedule(c, ["market", "segment"], 25_000, 3, 10_000, 100_000)


@query(
    """WITH m AS (SELECT o_custkey, o_orderkey AS decided_ns, (round(o_totalprice * 100)::BIGINT % 20001) - 10000 AS close FROM orders), x AS (SELECT *, close + 500 AS best, close - 700 AS worst, coalesce(sum(close) OVER (PARTITION BY o_custkey ORDER BY decided_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 50000 AS b FROM m),
p AS (SELECT *, greatest(50000, max(b + best) OVER (PARTITION BY o_custkey ORDER BY decided_ns)) AS peak FROM x), r AS (SELECT *, b + worst <= peak - 15000 AS breach FROM p), s AS (SELECT *, coalesce(sum(breach::INT) OVER (PARTITION BY o_custkey ORDER BY decided_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM r)
SELECT o_custkey, decided_ns, CASE WHEN broken > 0 THEN 'HALTED' WHEN breach THEN 'LIQUIDATED' ELSE 'OPEN' END AS state, peak::BIGINT AS peak, coalesce(CASE WHEN broken = 0 AND NOT breach THEN b + close END, 0)::BIGINT AS equity FROM s"""
)
def account_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-13: favourable before adverse extreme on every mark, until the floor is breached."""
    m = _pnl(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("at"), F.col("pnl").alias("close"), (F.col("pnl") + 500).alias("best"), (F.col("pnl") - 700).alias("worst"))
    return accounts.account_path(m, ["o_custkey"], 50_000, 15_000).select("o_custkey", F.col("at").alias("decided_ns"), "state", "peak", F.coalesce("equity", F.lit(0).cast("long")).alias("equity"))


@query("""WITH b AS (SELECT DISTINCT o_custkey, o_orderkey, round(o_totalprice)::BIGINT AS balance FROM orders) SELECT o_custkey, o_orderkey, least(450000, max(balance - 100000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS floor FROM b""")
def trailing_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-20."""
    b = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("balance"))
    return accounts.trailing_floor(b.union(b.where("o_orderkey % 5 = 0")), ["o_custkey"], "o_orderkey", "balance", 100_000, 450_000).select("o_custkey", "o_orderkey", F.col("floor").cast("long").alias("floor"))


@query(
    """WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey AS request, epoch(o_orderdate)::BIGINT AS at_s, floor(o_totalprice)::BIGINT AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate)::BIGINT, o_orderkey) AS i FROM orders),
p AS (SELECT DISTINCT o_custkey, 0::BIGINT AS i, 0::BIGINT AS paid, 0::BIGINT AS request, '' AS state FROM r UNION ALL SELECT r.o_custkey, r.i, p.paid + CASE WHEN 400000 - p.paid - r.amount >= 120000 THEN r.amount ELSE 0 END, r.request, CASE WHEN 400000 - p.paid - r.amount >= 120000 THEN 'PAID' ELSE 'REFUSED' END FROM p JOIN r ON r.o_custkey = p.o_custkey AND r.i = p.i + 1)
SELECT r.o_custkey, r.request, r.at_s AS "at", r.amount, p.state, CASE WHEN p.state = 'PAID' THEN round(r.amount * 0.9, 4) ELSE 0 END AS trader_share FROM r JOIN p ON p.o_custkey = r.o_custkey AND p.i = r.i"""
)
def payout_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-21: requests once each, against what earlier ones left."""
    o = tables.table(spark, sf_dir, "orders")
    r = o.select("o_custkey", F.col("o_orderkey").alias("request"), F.unix_seconds("o_orderdate").alias("at"), F.lit(400_000).alias("balance"), F.lit(100_000).alias("floor"), F.floor("o_totalprice").cast("long").alias("amount"))
    paid = accounts.payouts(r.union(r.where("request % 7 = 0")), ["o_custkey"], 20_000, 0.9)
    return paid.withColumn("trader_share", F.round("trader_share", 4))


@query("""WITH g AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS same, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT event_id, CASE WHEN same > 1 THEN 'DUPLICATE' WHEN n > 2 THEN 'RATE' ELSE 'OK' END AS state FROM g""")
def order_rate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-25."""
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds("ts").alias("s"))
    return accounts.order_guard(e, ["user_id"], "s", ["event_type"], 21_600, 2).select("event_id", "state")


@query("""WITH l AS (SELECT user_id, date_diff('day', max(ts)::DATE, DATE '2024-02-05') AS d, count(*) FILTER (event_type = 'purchase') AS minis, count(*) FILTER (event_type = 'click') AS micros FROM events GROUP BY 1)
SELECT user_id, CASE WHEN d >= 7 THEN 'CLOSED' WHEN d = 6 THEN 'FINAL_NOTICE' WHEN d = 5 THEN 'WARNING' ELSE 'ACTIVE' END AS state, minis * 10 + micros AS units FROM l""")
def inactivity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-22, K-26."""
    e = tables.table(spark, sf_dir, "events").groupBy("user_id").agg(F.datediff(F.lit("2024-02-05").cast("date"), F.to_date(F.max("ts"))).alias("d"), F.count_if(F.col("event_type") == "purchase").alias("minis"), F.count_if(F.col("event_type") == "click").alias("micros"))
    return e.select("user_id", accounts.inactivity("d").alias("state"), accounts.position_units("minis", "micros").alias("units"))


@query("""WITH e AS (SELECT o_custkey AS account, o_orderpriority AS symbol, 1 AS size, floor(o_totalprice / 1000)::BIGINT AS risk FROM orders WHERE o_orderstatus = 'O'), t AS (SELECT account, sum(risk) AS risk FROM e GROUP BY 1), s AS (SELECT account, symbol, sum(size) AS size FROM e GROUP BY 1, 2),
r AS (SELECT c_custkey AS account, '1-URGENT' AS symbol, 40 AS unit_risk, greatest(floor(c_acctbal), 0)::BIGINT AS cushion FROM customer), a AS (SELECT r.*, least(500 // 40, floor((2000 - coalesce(t.risk, 0)) / 40), 6 - coalesce(s.size, 0), floor((cushion - 100) / 40)) AS allowed FROM r LEFT JOIN t USING (account) LEFT JOIN s USING (account, symbol))
SELECT account, greatest(0, allowed)::BIGINT AS allowed, CASE WHEN allowed > 0 THEN 'SIZED' ELSE 'BREACH' END AS state FROM a""")
def order_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-23."""
    o = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    e = o.select(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("symbol"), F.lit(1).alias("size"), F.floor(F.col("o_totalprice") / 1000).alias("risk"))
    r = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.lit("1-URGENT").alias("symbol"), F.lit(40).alias("unit_risk"), F.greatest(F.floor("c_acctbal"), F.lit(0)).alias("cushion"))
    return accounts.order_size(r, e, "account", "symbol", {"trade_risk": 500, "open_risk": 2000, "symbol_size": 6, "reserve": 100}).select("account", "allowed", "state")


@query("""WITH c AS (SELECT event_type, event_id, value, value - avg(value) OVER (PARTITION BY event_type) AS c FROM events), l AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
g AS (SELECT event_type, count(*) AS n, avg(value) AS mean, sum(c * c) / count(*) + 2 * (2.0 / 3) * sum(c * c1) / count(*) + 2 * (1.0 / 3) * sum(c * c2) / count(*) AS lrv FROM l GROUP BY 1) SELECT event_type, n, round(mean, 6) AS mean, round(lrv, 5) AS long_run_variance, round(sqrt(greatest(lrv, 0) / n), 6) AS standard_error FROM g""")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-01."""
    r = inference.newey_west(tables.table(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 2)
    return r.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("long_run_variance", 5).alias("long_run_variance"), F.round("standard_error", 6).alias("standard_error"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by day and market: a series bounded by the calendar."""
    e = tables.table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.avg("value")).na.drop()


@query()
def stepdown_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-02, L-03: Romano-Wolf stepdown on stationary bootstrap resamples of daily means, market by market."""
    rows = _daily(spark, sf_dir).orderBy("day").toPandas()
    series = rows.iloc[:, 1:].to_numpy() - 50
    observed = [inference.hac_t(series[:, j], 2) for j in range(series.shape[1])]
    stats = inference.bootstrap_statistics(spark, series, 500, 6.0, 11, 2)
    p = inference.romano_wolf(stats, observed, 500)
    return spark.createDataFrame([(m, round(float(t), 6), float(q)) for m, t, q in zip(rows.columns[1:], observed, p, strict=True)], "market string, t double, p double")


@query(
    """WITH b AS (SELECT least((day(ts) - 1) // 4, 7) AS block, event_type AS strategy, round(sum(value), 2) AS total FROM events GROUP BY 1, 2), m AS (SELECT i FROM range(0, 256) t(i) WHERE bit_count(i::INT) = 4),
s AS (SELECT i, strategy, sum(CASE WHEN (i >> block) & 1 = 1 THEN total ELSE 0 END) AS a, sum(CASE WHEN (i >> block) & 1 = 1 THEN 0 ELSE total END) AS b FROM b, m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY a DESC, strategy) AS best, rank() OVER (PARTITION BY i ORDER BY b) AS place, count(*) OVER (PARTITION BY i, a) AS same FROM s)
SELECT strategy AS winner, count(*) AS combinations, round(avg((ln(place / 6.0 / (1 - place / 6.0)) <= 0)::INT), 6) AS pbo, count(*) FILTER (same > 1) AS tied FROM r WHERE best = 1 GROUP BY 1"""
)
def overfitting_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-04: combinatorially symmetric cross-validation over eight blocks of days."""
    e = tables.table(spark, sf_dir, "events")
    blocks = e.groupBy(F.least(F.floor((F.dayofmonth("ts") - 1) / 4), F.lit(7)).cast("int").alias("block"), F.col("event_type").alias("strategy")).agg(F.round(F.sum("value"), 2).alias("total"))
    c = inference.cscv(blocks, ["click", "error", "purchase", "signup", "view"], 8)
    return c.groupBy("winner").agg(F.count("*").alias("combinations"), F.round(F.avg((F.col("logit") <= 0).cast("double")), 6).alias("pbo"), F.count_if("tied").alias("tied"))


_Z = NormalDist().inv_cdf
_EXPECTED = (1 - 0.5772156649015329) * _Z(1 - 1 / 5) + 0.5772156649015329 * _Z(1 - 1 / (5 * math.e))


@query(
    f"""WITH x AS (SELECT event_type AS market, value - 45 AS x FROM events), a AS (SELECT market, avg(x) AS m FROM x GROUP BY 1), c AS (SELECT market, count(*) AS n, any_value(m) AS m, avg((x - m) ** 2) AS v2, avg((x - m) ** 3) AS v3, avg((x - m) ** 4) AS v4 FROM x JOIN a USING (market) GROUP BY 1),
s AS (SELECT *, m / sqrt(v2 * n / (n - 1)) AS s, v3 / v2 ** 1.5 AS skew, v4 / v2 ** 2 AS kurt FROM c), e AS (SELECT *, sqrt(var_samp(s) OVER ()) * {_EXPECTED} AS e FROM s), z AS (SELECT *, greatest(-12, least(12, (s - e) * sqrt(n - 1) / sqrt(1 - skew * s + (kurt - 1) / 4 * s ** 2))) AS z FROM e),
t AS (SELECT k, sum(ln(2 * k + 1)) OVER (ORDER BY k) AS d FROM range(0, 300) r(k)), p AS (SELECT market, sign(any_value(z)) * sum(exp((2 * k + 1) * ln(abs(z)) - d - z * z / 2)) / sqrt(2 * pi()) + 0.5 AS chance FROM z, t WHERE z <> 0 GROUP BY 1)
SELECT market, round(chance, 6) AS chance, round(({_Z(0.975)} + {_Z(0.8)}) * sqrt(v2 / n), 6) AS smallest_effect FROM z JOIN p USING (market)"""
)
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-05, L-06: Sharpe ratios against the best of so many trials, and the smallest effect in reach."""
    e = tables.table(spark, sf_dir, "events").withColumn("x", F.col("value") - 45)
    m = e.groupBy("event_type").agg(F.count("*").alias("n"), (F.avg("x") / F.stddev_samp("x")).alias("s"), F.skewness("x").alias("skew"), (F.kurtosis("x") + 3).alias("kurt"), F.var_pop("x").alias("v")).orderBy("event_type").collect()
    mean = sum(r["s"] for r in m) / len(m)
    spread = sum((r["s"] - mean) ** 2 for r in m) / (len(m) - 1)
    return spark.createDataFrame([(r["event_type"], round(inference.deflated_sharpe(r["s"], r["n"], r["skew"], r["kurt"], spread, len(m)), 6), round(inference.smallest_effect(r["v"], r["n"]), 6)) for r in m], "market string, chance double, smallest_effect double")


@query()
def bootstrap_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-07: share of resamples of a training series that a test rejects."""
    x = tables.table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("x")).orderBy("hour").toPandas()["x"].to_numpy()
    p = inference.bootstrap_power(spark, x, 2.0, 400, 5.0, 3, 2, 1.645)
    return p.agg(F.count("*").alias("resamples"), F.avg(F.col("rejected").cast("double")).alias("power"))


@query()
def bootstrap_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-08: quantiles of resampled means of an hourly series, for several lengths of blocks."""
    x = tables.table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("x")).orderBy("hour").toPandas()["x"].to_numpy()  # bounded by the calendar
    m = inference.bootstrap_means(spark, x, 300, [3, 6, 12], 7)
    return m.groupBy("block").agg(F.count("*").alias("resamples"), *(F.round(F.percentile("mean", q), 6).alias(n) for n, q in (("low", 0.025), ("one_sided", 0.05), ("high", 0.975))))


@query("""WITH i AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events), s AS (SELECT *, i // 10 AS b, i % 10 AS k, count(*) OVER (PARTITION BY event_type, i // 10) AS n FROM i)
SELECT a.event_type, a.event_id, a.value, c.value AS control FROM s a JOIN s c ON c.event_type = a.event_type AND c.b = a.b AND (c.k + 3) % c.n = a.k""")
def negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-09: values moved inside their blocks."""
    return inference.rolled_blocks(tables.table(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 10, 3)
