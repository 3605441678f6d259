"""Queries on exact, bitemporal and fold-wise joins, censuses and metrics of the research tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import asof, scans
from . import tables
from .registry import query

H, D, M = clock.HOUR, clock.DAY, clock.MINUTE


@query(
    f"""WITH {tables.TRADES}, r AS (SELECT market, contract, min(event_at_ns) AS effective, min(event_at_ns) + (count(*) % 5) * {H} AS available FROM trades GROUP BY 1, 2 UNION ALL SELECT market, min(contract) || 'x', min(event_at_ns), min(event_at_ns) + (count(*) % 5) * {H} FROM trades WHERE market = 'view' GROUP BY market, contract HAVING count(*) % 2 = 0),
d AS (SELECT event_id, market, event_at_ns AS decided FROM trades WHERE event_id % 5 = 0), j AS (SELECT d.event_id, d.market, r.contract, rank() OVER (PARTITION BY d.event_id ORDER BY r.effective DESC, r.available DESC) AS k FROM d JOIN r ON r.market = d.market AND r.effective <= d.decided AND r.available <= d.decided),
g AS (SELECT event_id, count(*) AS n, min(contract) AS contract FROM j WHERE k = 1 GROUP BY 1) SELECT d.event_id, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'SELECTED' END AS state, CASE WHEN n = 1 THEN contract ELSE '' END AS contract FROM d LEFT JOIN g USING (event_id)"""
)
def bitemporal_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-05, D-06: of the rolls in effect and known by the decision the one that took effect last; two of the same times are ambiguous.

    A decision meets its market's rolls, which are few (one in a week); no window over the market's trades is needed.
    """
    t = tables.trades(spark, sf_dir)
    r = t.groupBy("market", "contract").agg(F.min("event_at_ns").alias("effective"), F.count("*").alias("n"))
    twins = r.where("market = 'view' and n % 2 = 0").withColumn("contract", F.concat("contract", F.lit("x")))
    r = r.unionByName(twins).withColumn("available", F.col("effective") + (F.col("n") % 5) * H).drop("n")
    per_market = r.groupBy("market").agg(F.collect_list(F.struct("effective", "available", "contract")).alias("rolls"))
    d = t.where("event_id % 5 = 0").select("event_id", "market", F.col("event_at_ns").alias("decided")).join(per_market, "market", "left")
    known = F.filter("rolls", lambda x: (x["effective"] <= F.col("decided")) & (x["available"] <= F.col("decided")))
    top = F.array_max(F.transform(known, lambda x: F.struct(x["effective"], x["available"])))
    best = d.withColumn("known", known).withColumn("top", top)
    best = best.withColumn("same", F.filter("known", lambda x: (x["effective"] == F.col("top.effective")) & (x["available"] == F.col("top.available"))))
    n = F.size("same")
    state = F.when(F.col("top").isNull(), "UNRESOLVED").when(n > 1, "AMBIGUOUS").otherwise("SELECTED")
    return best.select("event_id", state.alias("state"), F.when(state == "SELECTED", F.get("same", 0)["contract"]).otherwise("").alias("contract"))


@query(
    """WITH r AS (SELECT n_nationkey AS market, (n_nationkey % 4 + 1) * 25 AS tick_cents, n_nationkey % 3 + 1 AS point, n_nationkey % 5 AS unit FROM nation WHERE n_nationkey <> 6), d AS (SELECT c_custkey, c_nationkey AS market, (CASE WHEN c_custkey % 17 = 0 THEN c_nationkey + 1 ELSE c_nationkey END) % 5 AS unit, c_custkey % 2 = 0 AS must FROM customer)
SELECT c_custkey, CASE WHEN r.market IS NULL THEN 'NO_RULE' WHEN must AND d.unit <> r.unit THEN 'UNIT_DIFFERS' ELSE 'RESOLVED' END AS state, CASE WHEN r.market IS NOT NULL AND NOT (must AND d.unit <> r.unit) THEN tick_cents * point ELSE -1 END AS tick_value_cents FROM d LEFT JOIN r USING (market)"""
)
def resolved_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-08, D-20: a market's rule and a contract's definition: the tick's value, and the provider's unit where it must match."""
    k = F.col("n_nationkey")
    r = tables.table(spark, sf_dir, "nation").where("n_nationkey <> 6").select(k.alias("market"), ((k % 4 + 1) * 25).alias("tick_cents"), (k % 3 + 1).alias("point"), (k % 5).alias("rule_unit"))
    c = tables.table(spark, sf_dir, "customer")
    own = F.when(F.col("c_custkey") % 17 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    d = c.select("c_custkey", F.col("c_nationkey").alias("market"), (own % 5).alias("unit"), (F.col("c_custkey") % 2 == 0).alias("must")).join(r, "market", "left")
    state = F.when(F.col("tick_cents").isNull(), "NO_RULE").when(F.col("must") & (F.col("unit") != F.col("rule_unit")), "UNIT_DIFFERS").otherwise("RESOLVED")
    return d.select("c_custkey", state.alias("state"), F.when(state == "RESOLVED", F.col("tick_cents") * F.col("point")).otherwise(-1).alias("tick_value_cents"))


@query(
    f"""WITH {tables.TRADES}, v AS (SELECT instrument_id % 30 AS contract, event_at_ns // {D} * {D} AS s, event_at_ns // {D} * {D} + (1 + max(event_id) % 3) * {D} AS e, max(event_id) AS record FROM trades WHERE event_id % 4 = 0 GROUP BY 1, 2, event_at_ns // {D}),
d AS (SELECT event_id, instrument_id % 30 AS contract, event_at_ns FROM trades WHERE event_id % 7 = 1), g AS (SELECT d.event_id, count(v.record) AS n, max(v.record) AS record FROM d LEFT JOIN v ON v.contract = d.contract AND d.event_at_ns >= v.s AND d.event_at_ns < v.e GROUP BY 1)
SELECT event_id, CASE WHEN n = 0 THEN 'NONE_VALID' WHEN n > 1 THEN 'SEVERAL_VALID' ELSE 'ONE_VALID' END AS state, CASE WHEN n = 1 THEN record ELSE -1 END AS record FROM g"""
)
def economics_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-09: exactly one record of the contract is valid at the decision."""
    t = tables.trades(spark, sf_dir)
    s = clock.floor_to("event_at_ns", D)
    v = t.where("event_id % 4 = 0").groupBy((F.col("instrument_id") % 30).alias("contract"), s.alias("s")).agg(F.max("event_id").alias("record")).withColumn("e", F.col("s") + (F.col("record") % 3 + 1) * D)
    d = t.where("event_id % 7 = 1").select("event_id", (F.col("instrument_id") % 30).alias("contract"), "event_at_ns")
    found = asof.in_interval(d, v, ["contract"], "event_at_ns", "s", "e", ["record"], D)
    g = found.groupBy("event_id").agg(F.count("record").alias("n"), F.max("record").alias("record"))
    state = F.when(F.col("n") == 0, "NONE_VALID").when(F.col("n") > 1, "SEVERAL_VALID").otherwise("ONE_VALID")
    return g.select("event_id", state.alias("state"), F.when(state == "ONE_VALID", F.col("record")).otherwise(F.lit(-1).cast("long")).alias("record"))


_SIDES = """f AS (SELECT sha256(o_orderkey::VARCHAR) AS h, o_orderkey AS id, o_orderkey % 11 <> 4 AS ready, o_custkey % 9 AS session, o_custkey % 4 AS identity, CASE o_orderkey % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' ELSE 'NEUTRAL' END AS direction FROM orders WHERE o_orderkey % 13 <> 5),
y AS (SELECT sha256(o_orderkey::VARCHAR) AS h, CASE WHEN o_orderkey % 7 = 2 THEN 'PENDING' ELSE 'MATURED' END AS status, (o_custkey + (o_orderkey % 31 = 9)::INT) % 9 AS session, (o_custkey + (o_orderkey % 37 = 9)::INT) % 4 AS identity, round(o_totalprice) AS long_y, -round(o_totalprice) / 2 AS short_y FROM orders WHERE o_orderkey % 17 <> 5)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k, c = tables.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    h = F.sha2(k.cast("string"), 256).alias("h")
    f = o.where("o_orderkey % 13 <> 5").select(h, k.alias("id"), (k % 11 != 4).alias("ready"), (c % 9).alias("session"), (c % 4).alias("identity"), F.when(k % 3 == 0, "LONG").when(k % 3 == 1, "SHORT").otherwise("NEUTRAL").alias("direction"))
    y = o.where("o_orderkey % 17 <> 5").select(
        h, F.when(k % 7 == 2, "PENDING").otherwise("MATURED").alias("status"), ((c + (k % 31 == 9).cast("int")) % 9).alias("y_session"), ((c + (k % 37 == 9).cast("int")) % 4).alias("y_identity"), F.round("o_totalprice").alias("long_y"), (-F.round("o_totalprice") / 2).alias("short_y"))
    return f, y


@query(f"""WITH {_SIDES} SELECT f.session, count(*) AS n, count(*) FILTER (f.session <> y.session) AS other_session, count(*) FILTER (f.identity <> y.identity) AS other_identity, count(*) FILTER (f.session <> y.session OR f.identity <> y.identity) = 0 AS certified FROM f JOIN y USING (h) WHERE ready AND status = 'MATURED' GROUP BY 1""")
def feature_outcome_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-12: ready features and matured outcomes by the hash of their source row; session and identity must be equal."""
    f, y = _sides(spark, sf_dir)
    a, b = F.col("session") != F.col("y_session"), F.col("identity") != F.col("y_identity")
    j = f.where("ready").join(y.where("status = 'MATURED'"), "h")
    return j.groupBy("session").agg(F.count("*").alias("n"), F.count_if(a).alias("other_session"), F.count_if(b).alias("other_identity"), (F.count_if(a | b) == 0).alias("certified"))


@query(f"""WITH {_SIDES} SELECT coalesce(f.session, y.session) AS session, count(*) FILTER (f.h IS NOT NULL AND y.h IS NOT NULL AND f.session = y.session) AS paired, count(*) FILTER (f.h IS NOT NULL AND y.h IS NOT NULL AND f.session <> y.session) AS timing_differs, count(*) FILTER (y.h IS NULL) AS features_only, count(*) FILTER (f.h IS NULL) AS outcomes_only, count(*) FILTER (f.session = y.session AND ready AND status = 'MATURED') AS mature FROM f FULL JOIN y ON f.h = y.h GROUP BY 1""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-13: features and outcomes one to one; what has no partner, whose timing differs, and mature samples per session."""
    f, y = _sides(spark, sf_dir)
    j = f.join(y, "h", "full_outer")
    x, o = F.col("id").isNotNull(), F.col("status").isNotNull()
    same = F.col("session") == F.col("y_session")
    return j.groupBy(F.coalesce("session", "y_session").alias("session")).agg(
        F.count_if(x & o & same).alias("paired"), F.count_if(x & o & ~same).alias("timing_differs"), F.count_if(~o).alias("features_only"), F.count_if(~x).alias("outcomes_only"), F.count_if(same & F.col("ready") & (F.col("status") == "MATURED")).alias("mature"))


@query(f"""WITH {_SIDES} SELECT f.id, f.direction, coalesce(y.status, 'MISSING') AS status, CASE WHEN y.status = 'MATURED' THEN CASE f.direction WHEN 'LONG' THEN long_y ELSE short_y END ELSE 0 END AS outcome FROM f LEFT JOIN y USING (h) WHERE f.direction <> 'NEUTRAL'""")
def directional_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-14, D-16, D-19: the label of the side that was predicted; neutral ones go, all others stay, with or without an outcome."""
    f, y = _sides(spark, sf_dir)
    j = f.where("direction <> 'NEUTRAL'").join(y, "h", "left")
    side = F.when(F.col("direction") == "LONG", F.col("long_y")).otherwise(F.col("short_y"))
    return j.select("id", "direction", F.coalesce("status", F.lit("MISSING")).alias("status"), F.when(F.col("status") == "MATURED", side).otherwise(0.0).alias("outcome"))


@query(
    f"""WITH {tables.bars_sql()}, p AS (SELECT market, event_at_ns AS entry_at, event_at_ns + (1 + volume % 3) * {H} AS exit_at, sha256(contract || event_at_ns) AS h, contract FROM bars WHERE volume % 4 <> 1), f AS (SELECT sha256(contract || event_at_ns) AS h, volume AS x FROM bars WHERE volume % 5 <> 2), o AS (SELECT sha256(contract || event_at_ns) AS h, close_nano AS y FROM bars WHERE volume % 6 <> 3),
b AS (SELECT market, event_at_ns, min(contract) AS c, count(*) AS n, min(open_nano) AS open_nano FROM bars GROUP BY 1, 2)
SELECT p.market, p.contract, p.entry_at, CASE WHEN f.h IS NULL THEN 'NO_FEATURES' WHEN o.h IS NULL THEN 'NO_OUTCOME' WHEN i.n IS NULL OR e.n IS NULL THEN 'NO_BAR' WHEN i.n > 1 OR e.n > 1 THEN 'AMBIGUOUS_BAR' WHEN i.c <> p.contract OR e.c <> p.contract THEN 'EXCLUDED_ROLL' ELSE 'CONVERTED' END AS state,
 CASE WHEN f.h IS NOT NULL AND o.h IS NOT NULL AND i.n = 1 AND e.n = 1 AND i.c = p.contract AND e.c = p.contract THEN e.open_nano - i.open_nano ELSE 0 END AS move_nano
FROM p LEFT JOIN f USING (h) LEFT JOIN o USING (h) LEFT JOIN b i ON i.market = p.market AND i.event_at_ns = p.entry_at LEFT JOIN b e ON e.market = p.market AND e.event_at_ns = p.exit_at"""
)
def execution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-15: predictions with features and outcomes by hash, then bars at entry and exit; a changed contract is an excluded roll."""
    b = tables.bars(spark, sf_dir)
    h = F.sha2(F.concat("contract", F.col("event_at_ns").cast("string")), 256).alias("h")
    p = b.where("volume % 4 <> 1").select("market", "contract", F.col("event_at_ns").alias("entry_at"), (F.col("event_at_ns") + (F.col("volume") % 3 + 1) * H).alias("exit_at"), h)
    j = p.join(b.where("volume % 5 <> 2").select(h, F.col("volume").alias("x")), "h", "left").join(b.where("volume % 6 <> 3").select(h, F.col("close_nano").alias("y")), "h", "left")
    at = b.groupBy("market", "event_at_ns").agg(F.struct(F.min("contract").alias("c"), F.count("*").alias("n"), F.min("open_nano").alias("open")).alias("bar"))
    for name, when in (("i", "entry_at"), ("e", "exit_at")):
        j = j.join(at.select("market", F.col("event_at_ns").alias(when), F.col("bar").alias(name)), ["market", when], "left")
    own = F.col("contract")
    state = (
        F.when(F.col("x").isNull(), "NO_FEATURES").when(F.col("y").isNull(), "NO_OUTCOME").when(F.col("i").isNull() | F.col("e").isNull(), "NO_BAR").when((F.col("i.n") > 1) | (F.col("e.n") > 1), "AMBIGUOUS_BAR")
        .when((F.col("i.c") != own) | (F.col("e.c") != own), "EXCLUDED_ROLL").otherwise("CONVERTED"))
    return j.select("market", "contract", "entry_at", state.alias("state"), F.when(state == "CONVERTED", F.col("e.open") - F.col("i.open")).otherwise(F.lit(0).cast("long")).alias("move_nano"))


@query(
    """WITH c AS (SELECT user_id % 8 AS file, event_id, CASE WHEN event_id % 211 = 3 THEN NULL ELSE epoch_us(ts) * 1000 END AS e, CASE WHEN event_id % 307 = 3 THEN NULL ELSE epoch_us(ts) * 1000 + (event_id % 9 - 2) * 3600000000000 END AS r FROM events), l AS (SELECT *, lag(r) OVER (PARTITION BY file ORDER BY event_id) AS was FROM c)
SELECT file, count(*) AS n, count(*) FILTER (r - e < 0) AS negative, count(*) FILTER (r = e) AS zero, count(*) FILTER (r - e > 0) AS positive, count(*) FILTER (r // 86400000000000 <> e // 86400000000000) AS cross_date, count(*) FILTER (e IS NULL) AS no_event, count(*) FILTER (r IS NULL) AS no_receipt, count(*) FILTER (r < was) AS order_violations, min(r - e) AS least_ns, max(r - e) AS most_ns FROM l GROUP BY 1"""
)
def timestamp_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-05, E-06: receipts against events in each file: signs, dates, undefined ones, order, extremes; counts that merge over files."""
    e = tables.table(spark, sf_dir, "events")
    at, i = clock.ns("ts"), F.col("event_id")
    c = e.select((F.col("user_id") % 8).alias("file"), "event_id", F.when(i % 211 != 3, at).alias("e"), F.when(i % 307 != 3, at + (i % 9 - 2) * H).alias("r"))
    c = c.withColumn("was", F.lag("r").over(Window.partitionBy("file").orderBy("event_id")))
    d = F.col("r") - F.col("e")
    day = lambda x: clock.floor_div(x, D)
    return c.groupBy("file").agg(
        F.count("*").alias("n"), F.count_if(d < 0).alias("negative"), F.count_if(d == 0).alias("zero"), F.count_if(d > 0).alias("positive"), F.count_if(day("r") != day("e")).alias("cross_date"), F.count_if(F.col("e").isNull()).alias("no_event"),
        F.count_if(F.col("r").isNull()).alias("no_receipt"), F.count_if(F.col("r") < F.col("was")).alias("order_violations"), F.min(d).alias("least_ns"), F.max(d).alias("most_ns"))


@query(
    """WITH p AS (SELECT user_id % 12 AS scenario, event_id, value - 45 AS pnl, (event_id % 3 - 1) AS q, event_id % 60 AS minutes, CASE WHEN event_id % 8 = 0 THEN 'ABSTAIN' WHEN value > 100 THEN 'TARGET' WHEN value < 10 THEN 'STOP' ELSE 'TIMEOUT' END AS reason FROM events),
r AS (SELECT *, sum(pnl) OVER (PARTITION BY scenario ORDER BY event_id) AS equity FROM p), m AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY scenario ORDER BY event_id)) - equity AS dd FROM r)
SELECT scenario, count(*) AS n, round(sum(pnl), 4) AS net, round(CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END, 6) AS sharpe, round(CASE WHEN sum(least(pnl, 0) * least(pnl, 0)) > 0 THEN avg(pnl) / sqrt(sum(least(pnl, 0) * least(pnl, 0)) / count(*)) ELSE 0 END, 6) AS sortino,
 round(max(dd), 4) AS max_drawdown, sum(abs(q))::BIGINT AS turnover, round(avg((pnl > 0)::INT), 6) AS hit_rate, sum(abs(q) * minutes)::BIGINT AS gross_exposure, sum(q * minutes)::BIGINT AS net_exposure, count(*) FILTER (reason = 'STOP') AS stops, count(*) FILTER (reason = 'TARGET') AS targets, count(*) FILTER (reason = 'TIMEOUT') AS timeouts, count(*) FILTER (reason = 'ABSTAIN') AS abstained FROM m GROUP BY 1"""
)
def account_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-12, E-14: net, Sharpe and Sortino per period (0 without spread), drawdown, turnover, hits, exposures, exits and abstentions."""
    i, v = F.col("event_id"), F.col("value")
    p = tables.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 12).alias("scenario"), "event_id", (v - 45).alias("pnl"), (i % 3 - 1).alias("q"), (i % 60).alias("minutes"), F.when(i % 8 == 0, "ABSTAIN").when(v > 100, "TARGET").when(v < 10, "STOP").otherwise("TIMEOUT").alias("reason"))
    w = Window.partitionBy("scenario").orderBy("event_id")
    m = p.withColumn("equity", F.sum("pnl").over(w)).withColumn("dd", F.greatest(F.lit(0.0), F.max("equity").over(w)) - F.col("equity"))
    down = F.sum(F.pow(F.least("pnl", F.lit(0.0)), 2))
    spread = F.stddev_pop("pnl")
    exits = [F.count_if(F.col("reason") == r).alias(n) for r, n in (("STOP", "stops"), ("TARGET", "targets"), ("TIMEOUT", "timeouts"), ("ABSTAIN", "abstained"))]
    return m.groupBy("scenario").agg(
        F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("net"), F.round(F.when(spread > 0, F.avg("pnl") / spread).otherwise(0.0), 6).alias("sharpe"), F.round(F.when(down > 0, F.avg("pnl") / F.sqrt(down / F.count("*"))).otherwise(0.0), 6).alias("sortino"),
        F.round(F.max("dd"), 4).alias("max_drawdown"), F.sum(F.abs("q")).alias("turnover"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 6).alias("hit_rate"), F.sum(F.abs("q") * F.col("minutes")).alias("gross_exposure"), F.sum(F.col("q") * F.col("minutes")).alias("net_exposure"), *exits)


@query(
    f"""WITH {tables.TRADES}, r AS (SELECT market, (event_at_ns - 1704067200000000000) // {D} AS day, event_at_ns // {H} % 24 AS hour_no, price_nano // 1000000 - 45000 AS y FROM trades WHERE event_id % 2 = 0), f AS (SELECT * FROM (VALUES (0, 0, 10), (1, 5, 20), (2, 0, 2)) v(fold, a, b)),
c AS (SELECT market, fold, hour_no, sum(y)::BIGINT AS s FROM r JOIN f ON day >= a AND day < b GROUP BY 1, 2, 3), m AS (SELECT market, fold, sum(y)::BIGINT AS s FROM r JOIN f ON day >= a AND day < b GROUP BY 1, 2), g AS (SELECT market, fold, h FROM (SELECT DISTINCT market FROM r), f, range(0, 24) t(h))
SELECT g.market, g.fold, g.h AS hour_no, CASE WHEN c.s IS NOT NULL THEN 'CELL' WHEN m.s IS NOT NULL THEN 'FALLBACK' ELSE 'NONE' END AS basis, CASE WHEN coalesce(c.s, m.s) > 0 THEN 'LONG' WHEN coalesce(c.s, m.s) < 0 THEN 'SHORT' WHEN coalesce(c.s, m.s) = 0 THEN 'ZERO_ERROR' ELSE 'NONE' END AS direction
FROM g LEFT JOIN c ON c.market = g.market AND c.fold = g.fold AND c.hour_no = g.h LEFT JOIN m ON m.market = g.market AND m.fold = g.fold"""
)
def fold_local_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-15: the sign of training returns per market, fold and hour, of market and fold where a cell is empty; a row is in several folds."""
    t = tables.trades(spark, sf_dir).where("event_id % 2 = 0")
    folds = ((0, 0, 10), (1, 5, 20), (2, 0, 2))
    day = clock.floor_div(F.col("event_at_ns") - 1704067200 * 10**9, D)
    own = F.array_compact(F.array(*(F.when((day >= a) & (day < b), F.lit(k)) for k, a, b in folds)))
    r = t.select("market", (clock.floor_div("event_at_ns", H) % 24).alias("hour_no"), (clock.floor_div("price_nano", 1_000_000) - 45_000).alias("y"), F.explode(own).alias("fold"))
    cells = r.groupBy("market", "fold", "hour_no").agg(F.sum("y").alias("s"))
    whole = cells.groupBy("market", "fold").agg(F.sum("s").alias("m"))
    grid = t.select("market").distinct().withColumn("fold", F.explode(F.array(*(F.lit(k) for k, _, _ in folds)))).withColumn("hour_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    j = grid.join(cells, ["market", "fold", "hour_no"], "left").join(whole, ["market", "fold"], "left")
    x = F.coalesce("s", "m")
    basis = F.when(F.col("s").isNotNull(), "CELL").when(F.col("m").isNotNull(), "FALLBACK").otherwise("NONE")
    return j.select("market", "fold", "hour_no", basis.alias("basis"), F.when(x > 0, "LONG").when(x < 0, "SHORT").when(x == 0, "ZERO_ERROR").otherwise("NONE").alias("direction"))


@query(
    f"""WITH {tables.TRADES}, s AS (SELECT market, event_at_ns // {6 * H} AS tm, instrument_id % 4 AS instrument, event_id, event_id % 5 AS body FROM trades), k AS (SELECT market, tm, count(DISTINCT instrument) AS ids, count(*) AS n, count(DISTINCT body) AS bodies, min(instrument) AS instrument FROM s GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN instrument IS DISTINCT FROM lag(instrument) OVER (PARTITION BY market ORDER BY tm) THEN 1 ELSE 0 END AS new FROM k), i AS (SELECT *, sum(new) OVER (PARTITION BY market ORDER BY tm) AS island FROM l), y AS (SELECT market, tm // 1460 AS year, instrument, count(DISTINCT island) AS islands FROM i GROUP BY 1, 2, 3)
SELECT market, (SELECT count(*) FROM k WHERE k.market = i.market AND n > 1 AND bodies = 1) AS exact_duplicates, (SELECT count(*) FROM k WHERE k.market = i.market AND n > 1 AND bodies > 1) AS distinct_duplicates, (SELECT count(*) FROM k WHERE k.market = i.market AND ids > 1) AS ambiguous, sum(new)::BIGINT - 1 AS transitions,
 (SELECT count(*) FROM (SELECT instrument FROM i j WHERE j.market = i.market GROUP BY 1 HAVING count(DISTINCT island) > 1)) AS reappearing, (SELECT count(*) FROM y WHERE y.market = i.market AND islands > 1) AS reappearing_in_year FROM i GROUP BY market"""
)
def roll_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-25, E-26, E-29: duplicates of a time, exact or not, ambiguous identities, transitions, and instruments that come back within a year or over all."""
    t = tables.trades(spark, sf_dir).select("market", clock.floor_div("event_at_ns", 6 * H).alias("at"), (F.col("instrument_id") % 4).alias("instrument"), (F.col("event_id") % 5).alias("body"))
    k = t.groupBy("market", "at").agg(F.count_distinct("instrument").alias("ids"), F.count("*").alias("n"), F.count_distinct("body").alias("bodies"), F.min("instrument").alias("instrument"))
    k = scans.previous(k, ["market"], ["at"], {"instrument": "was"}, 1_000)
    i = k.withColumn("new", (~F.col("instrument").eqNullSafe(F.col("was"))).cast("int"))
    i = scans.after_first(i, ["market"], ["at"], "new", "islands_before", 1_000).withColumn("island", F.col("islands_before") + F.col("new"))
    one = i.groupBy("market").agg(
        F.count_if(F.expr("n > 1 and bodies = 1")).alias("exact_duplicates"), F.count_if(F.expr("n > 1 and bodies > 1")).alias("distinct_duplicates"), F.count_if(F.col("ids") > 1).alias("ambiguous"), (F.sum("new") - 1).alias("transitions"))
    per_year = i.groupBy("market", clock.floor_div("at", 1460).alias("year"), "instrument").agg(F.count_distinct("island").alias("islands"), F.min("island").alias("first"), F.max("island").alias("last"))
    over = per_year.groupBy("market", "instrument").agg(F.count_if(F.col("islands") > 1).alias("years"), (F.max("last") > F.min("first")).alias("back"))
    back = over.groupBy("market").agg(F.count_if("back").alias("reappearing"), F.sum("years").alias("reappearing_in_year"))
    return one.join(back, "market")


@query("""SELECT n_name AS market, count(*) AS n, count(*) FILTER (o_orderkey % 6 = 0) AS abstained, sha256(string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS census FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def prediction_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-30: how many predictions a ledger holds, abstentions included, and the hash of all in their order."""
    o, c, n = (tables.table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    row = F.struct("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_orderstatus")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["text"]), ",")
    return j.groupBy(F.col("n_name").alias("market")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 6 == 0).alias("abstained"), F.sha2(text, 256).alias("census"))


@query(
    """WITH h AS (SELECT l_suppkey % 6 AS market, year(l_shipdate) AS year, count(*) AS n FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2), e AS (SELECT l_suppkey % 6 AS market, year(l_shipdate) AS year, count(*) AS n FROM lineitem WHERE l_suppkey % 6 <> 4 OR year(l_shipdate) < 1996 GROUP BY 1, 2)
SELECT coalesce(h.market, e.market)::BIGINT AS market, coalesce(h.year, e.year) AS year, coalesce(h.n, 0) AS rows, coalesce(e.n, 0) AS expected, CASE WHEN h.n IS NULL THEN 'MISSING' WHEN e.n IS NULL THEN 'UNEXPECTED' WHEN h.n < e.n THEN 'SHORT' ELSE 'COVERED' END AS state FROM h FULL JOIN e ON h.market = e.market AND h.year = e.year"""
)
def market_year_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-31: rows of every market and year against those expected."""
    i = tables.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 6).alias("market"), F.year("l_shipdate").cast("long").alias("year"), "l_linenumber")
    h = i.where("l_linenumber < 6").groupBy("market", "year").agg(F.count("*").alias("rows"))
    e = i.where("market <> 4 or year < 1996").groupBy("market", "year").agg(F.count("*").alias("expected"))
    a, b = F.col("rows"), F.col("expected")
    state = F.when(a.isNull(), "MISSING").when(b.isNull(), "UNEXPECTED").when(a < b, "SHORT").otherwise("COVERED")
    return h.join(e, ["market", "year"], "full_outer").select("market", "year", F.coalesce(a, F.lit(0).cast("long")).alias("rows"), F.coalesce(b, F.lit(0).cast("long")).alias("expected"), state.alias("state"))


@query(
    f"""WITH {tables.TRADES}, s AS (SELECT market, event_at_ns // {D} AS day, count(*) FILTER (price_nano > 30000000000) AS ready, count(*) AS n, max(event_id) AS last_id FROM trades GROUP BY 1, 2), x AS (SELECT *, CASE WHEN ready >= 33 THEN 'COMPLETE' WHEN n < 60 THEN 'THIN_SESSION' ELSE 'UNPRICED' END AS reason, dense_rank() OVER (ORDER BY day) - 1 AS i FROM s),
r AS (SELECT f AS fold, CASE WHEN i < 5 + 5 * f THEN 'TRAIN' ELSE 'TEST' END AS role, x.* FROM x, range(0, 4) t(f) WHERE i < 10 + 5 * f)
SELECT fold, role, market, count(*) AS expected, count(*) FILTER (reason = 'COMPLETE') AS complete, count(*) FILTER (reason = 'THIN_SESSION') AS thin, count(*) FILTER (reason = 'UNPRICED') AS unpriced, count(*) FILTER (reason = 'COMPLETE') >= 0.6 * count(*) AS ready FROM r GROUP BY 1, 2, 3"""
)
def fold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-28, F-18, Q-27: folds from the calendar alone, then expected and complete sessions of each fold, role and market, with reasons."""
    t = tables.trades(spark, sf_dir)
    s = t.groupBy("market", clock.floor_div("event_at_ns", D).alias("day")).agg(F.count_if(F.col("price_nano") > 30_000_000_000).alias("priced"), F.count("*").alias("n"))
    calendar = s.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)  # one row for each day of the calendar
    x = s.join(F.broadcast(calendar), "day").withColumn("reason", F.when(F.col("priced") >= 33, "COMPLETE").when(F.col("n") < 60, "THIN_SESSION").otherwise("UNPRICED"))
    r = x.withColumn("fold", F.explode(F.array(*(F.lit(k).cast("long") for k in range(4))))).where(F.col("i") < F.col("fold") * 5 + 10)
    r = r.withColumn("role", F.when(F.col("i") < F.col("fold") * 5 + 5, "TRAIN").otherwise("TEST"))
    of = lambda k, name: F.count_if(F.col("reason") == k).alias(name)
    return r.groupBy("fold", "role", "market").agg(F.count("*").alias("expected"), of("COMPLETE", "complete"), of("THIN_SESSION", "thin"), of("UNPRICED", "unpriced"), (F.count_if(F.col("reason") == "COMPLETE") >= F.lit(0.6) * F.count("*")).alias("ready"))


@query(
    f"""WITH {tables.TRADES}, c AS (SELECT market, event_at_ns // {D} AS day, k, count(*) FILTER (event_at_ns // {H} % 24 BETWEEN k - 2 AND k - 1) AS before_n, count(*) FILTER (event_at_ns // {H} % 24 = k) AS at_n FROM trades, (VALUES (9), (13), (17)) v(k) GROUP BY 1, 2, 3)
SELECT market, k AS checkpoint, count(*) AS sessions, count(*) FILTER (before_n > 0) AS features, count(*) FILTER (before_n > 0 AND at_n > 0) AS candidates, count(*) FILTER (at_n > 0) AS always_long, count(*) FILTER (before_n > 1 AND at_n > 0) AS momentum, round(100.0 * count(*) FILTER (before_n > 0 AND at_n > 0) / count(*), 4) AS candidate_percent FROM c GROUP BY 1, 2"""
)
def universe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-27: of each checkpoint's sessions, those with features, a candidate, and each baseline."""
    t = tables.trades(spark, sf_dir).select("market", clock.floor_div("event_at_ns", D).alias("day"), (clock.floor_div("event_at_ns", H) % 24).alias("hour_no"))
    per_day = t.groupBy("market", "day").agg(*(F.struct(F.count_if(F.col("hour_no").between(k - 2, k - 1)).alias("b"), F.count_if(F.col("hour_no") == k).alias("a")).alias(f"k{k}") for k in (9, 13, 17)))
    c = per_day.select("market", F.explode(F.array(*(F.struct(F.lit(k).alias("checkpoint"), f"k{k}.*") for k in (9, 13, 17)))).alias("c")).select("market", "c.*")
    n = lambda e, name: F.count_if(F.expr(e)).alias(name)
    return c.groupBy("market", "checkpoint").agg(F.count("*").alias("sessions"), n("b > 0", "features"), n("b > 0 and a > 0", "candidates"), n("a > 0", "always_long"), n("b > 1 and a > 0", "momentum"), F.round(F.count_if(F.expr("b > 0 and a > 0")) * 100.0 / F.count("*"), 4).alias("candidate_percent"))
