"""Queries on trials: checkpoint classes, two-sided models, plans before outcomes, universes, coverage, merges, certification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, codes
from ..operators import labels, ridge, scans, windows
from . import tables
from .registry import query
from .research import _solved

H, D, M = clock.HOUR, clock.DAY, clock.MINUTE
_T0 = 1704067200 * 10**9
_RIDGE = "SELECT l_suppkey % 3 AS market, l_linenumber % 4 AS fold, l_orderkey % 5 AS checkpoint, l_orderkey AS id, l_quantity AS x0, l_discount AS x1, l_extendedprice / 10000 - 3 AS y, 2 - l_extendedprice / 15000 AS s FROM lineitem"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = tables.table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    return i.select((F.col("l_suppkey") % 3).alias("market"), (F.col("l_linenumber") % 4).cast("int").alias("fold"), (F.col("l_orderkey") % 5).alias("checkpoint"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("x0"), F.col("l_discount").alias("x1"), (p / 10000 - 3).alias("y"), (2 - p / 15000).alias("s"))


@query(
    f"""WITH r AS ({_RIDGE}), t AS (SELECT r.*, f AS test FROM r, range(0, 4) g(f) WHERE fold < f AND NOT (checkpoint = 4 AND f = 1)), {_solved("market, test", "t", ["x0", "x1"], "l")},
u AS (SELECT * REPLACE (s AS y) FROM t), {_solved("market, test", "u", ["x0", "x1"], "s")},
c AS (SELECT market, test, checkpoint, avg(y) AS long_mean, avg(s) AS short_mean, count(*) AS n FROM t GROUP BY 1, 2, 3), p AS (SELECT r.market, r.fold, r.checkpoint, m.intercept + m.w0 * x0 + m.w1 * x1 AS l, ms.intercept + ms.w0 * x0 + ms.w1 * x1 AS sh FROM r JOIN lm m ON m.market = r.market AND m.test = r.fold JOIN sm ms ON ms.market = r.market AND ms.test = r.fold)
SELECT p.market, p.fold, p.checkpoint, count(*) AS n, count(*) FILTER (greatest(l, sh) < 0.25) AS neutral, count(*) FILTER (greatest(l, sh) >= 0.25 AND l >= sh) AS longs, any_value(CASE WHEN c.n IS NULL THEN 'NO_TRAINING_OUTCOME_ABSTAIN' WHEN long_mean >= short_mean THEN 'LONG' ELSE 'SHORT' END) AS baseline, round(avg(l), 4) AS mean_long, round(avg(sh), 4) AS mean_short
FROM p LEFT JOIN c ON c.market = p.market AND c.test = p.fold AND c.checkpoint = p.checkpoint GROUP BY 1, 2, 3"""
)
def two_sided_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-05, Q-01: long and short returns by market and fold from earlier folds; under 0.25 a prediction is neutral, and a checkpoint without training outcomes has no baseline."""
    r = _rows(spark, sf_dir)
    t = r.withColumn("test", F.explode(F.array(*map(F.lit, range(4))))).where("fold < test and not (checkpoint = 4 and test = 1)")
    models = ridge.fit(t, ["market", "test"], ["x0", "x1"], ["y", "s"], 1.0)
    p = r.withColumn("test", F.col("fold"))
    for target, name in (("y", "l"), ("s", "sh")):
        p = ridge.predicted(p, models, ["market", "test"], ["x0", "x1"], target).withColumnRenamed("prediction", name)
    cells = t.groupBy("market", "test", "checkpoint").agg(F.avg("y").alias("long_mean"), F.avg("s").alias("short_mean"))
    top = F.greatest("l", "sh")
    baseline = F.when(F.col("long_mean").isNull(), "NO_TRAINING_OUTCOME_ABSTAIN").when(F.col("long_mean") >= F.col("short_mean"), "LONG").otherwise("SHORT")
    return p.where("l is not null").join(cells, ["market", "test", "checkpoint"], "left").groupBy("market", "fold", "checkpoint").agg(
        F.count("*").alias("n"), F.count_if(top < 0.25).alias("neutral"), F.count_if((top >= 0.25) & (F.col("l") >= F.col("sh"))).alias("longs"), F.max(baseline).alias("baseline"), F.round(F.avg("l"), 4).alias("mean_long"), F.round(F.avg("sh"), 4).alias("mean_short"))


@query(
    f"""WITH r AS (SELECT * REPLACE (CASE WHEN market = 2 THEN 7 ELSE x1 END AS x1) FROM ({_RIDGE})), {_solved("market", "r", ["x0", "x1"], raw=True)} SELECT market, n, round(w0, 6) AS w0, round(w1, 6) AS w1, round(intercept, 5) AS intercept FROM m"""
)
def raw_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03, J-06: features as they are, a free intercept that isn't penalised; a constant feature weighs nothing."""
    r = _rows(spark, sf_dir).withColumn("x1", F.when(F.col("market") == 2, 7.0).otherwise(F.col("x1")))
    m = ridge.fit(r, ["market"], ["x0", "x1"], ["y"], 1.0, standardised=False)
    return m.select("market", "n", F.round(F.col("weights")[0], 6).alias("w0"), F.round(F.col("weights")[1], 6).alias("w1"), F.round("intercept", 5).alias("intercept"))


@query(
    f"""WITH {tables.TRADES}, c AS (SELECT DISTINCT market, event_at_ns // {D} * {D} + k * {H} AS cp FROM trades, (VALUES (9), (13), (17)) v(k)), b AS (SELECT c.market, c.cp, t.event_at_ns AS tm FROM c JOIN trades t ON t.market = c.market AND t.event_at_ns BETWEEN c.cp - {6 * H} AND c.cp + {9 * H}),
g AS (SELECT market, cp, count(*) FILTER (tm < cp) AS before_n, min(tm) FILTER (tm < cp) AS first_tm, max(tm) FILTER (tm < cp) AS last_tm, count(*) FILTER (tm BETWEEN cp + {H} AND cp + {3 * H}) AS entries, count(*) FILTER (tm BETWEEN cp + {6 * H} AND cp + {9 * H}) AS exits FROM b GROUP BY 1, 2)
SELECT c.market, c.cp AS checkpoint_ns, CASE WHEN coalesce(before_n, 0) < 2 THEN 'TOO_FEW_FEATURE_BARS' WHEN first_tm > c.cp - {4 * H} THEN 'FIRST_FEATURE_LATE' WHEN last_tm < c.cp - {2 * H} THEN 'LAST_FEATURE_STALE' WHEN entries = 0 THEN 'NO_ENTRY' WHEN exits = 0 THEN 'NO_EXIT' ELSE 'COMPLETE' END AS disposition FROM c LEFT JOIN g USING (market, cp)"""
)
def fixed_horizon_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-07: enough feature bars, the first early and the last late enough, a bar in the entry's and one in the exit's window; the first failure tells."""
    t = tables.trades(spark, sf_dir)
    c = t.select("market", clock.floor_to("event_at_ns", D).alias("day")).distinct().withColumn("cp", F.explode(F.array(*(F.col("day") + k * H for k in (9, 13, 17))))).drop("day")
    near = t.select("market", F.col("event_at_ns").alias("tm"))
    # a bar belongs to the checkpoints of its day and the two next to it
    cps = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(F.array(F.lit(9), F.lit(13), F.lit(17)), lambda k: clock.floor_to("tm", D) + d * D + k * H)))
    b = near.withColumn("cp", F.explode(cps)).where((F.col("tm") >= F.col("cp") - 6 * H) & (F.col("tm") <= F.col("cp") + 9 * H))
    tm, cp = F.col("tm"), F.col("cp")
    before = tm < cp
    g = b.groupBy("market", "cp").agg(
        F.count_if(before).alias("n"), F.min(F.when(before, tm)).alias("first"), F.max(F.when(before, tm)).alias("last"), F.count_if(tm.between(cp + H, cp + 3 * H)).alias("entries"), F.count_if(tm.between(cp + 6 * H, cp + 9 * H)).alias("exits"))
    code = codes.first_reason((F.col("n") >= 2, "TOO_FEW_FEATURE_BARS"), (F.col("first") <= cp - 4 * H, "FIRST_FEATURE_LATE"), (F.col("last") >= cp - 2 * H, "LAST_FEATURE_STALE"), (F.col("entries") > 0, "NO_ENTRY"), (F.col("exits") > 0, "NO_EXIT"))
    return c.join(g, ["market", "cp"], "left").select("market", cp.alias("checkpoint_ns"), F.coalesce(code, F.lit("COMPLETE")).alias("disposition"))


@query(
    f"""WITH {tables.TRADES}, d AS (SELECT event_id, market, event_at_ns AS cp FROM trades WHERE event_id % 9 = 0), g AS (SELECT d.event_id, d.cp, min(t.event_at_ns) AS trig FROM d JOIN trades t ON t.market = d.market AND t.event_at_ns > d.cp AND t.event_at_ns <= d.cp + {H} GROUP BY 1, 2),
f AS (SELECT d.event_id, min(t.event_at_ns) AS fill FROM d JOIN g USING (event_id) JOIN trades t ON t.market = d.market AND t.event_at_ns > g.trig AND t.event_at_ns <= g.trig + {H} GROUP BY 1), x AS (SELECT d.event_id, min(t.event_at_ns) AS leave FROM d JOIN f USING (event_id) JOIN trades t ON t.market = d.market AND t.event_at_ns >= f.fill + {5 * H} AND t.event_at_ns <= f.fill + {6 * H} GROUP BY 1)
SELECT d.event_id, CASE WHEN trig IS NULL THEN 'NO_TRIGGER' WHEN fill IS NULL THEN 'NO_FILL' WHEN leave IS NULL THEN 'NO_EXIT' ELSE 'COMPLETE' END AS disposition, coalesce(leave - d.cp, -1) AS held_ns FROM d LEFT JOIN g USING (event_id) LEFT JOIN f USING (event_id) LEFT JOIN x USING (event_id)"""
)
def triggered_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-08: from a checkpoint to a trigger, a fill soon after it and an exit in time; the first step that fails tells."""
    t = tables.trades(spark, sf_dir).select("market", F.col("event_at_ns").alias("tm")).withColumn("step", clock.floor_div("tm", H))
    d = tables.trades(spark, sf_dir).where("event_id % 9 = 0").select("event_id", "market", F.col("event_at_ns").alias("cp"))

    def first(rows: DataFrame, at: str, after: int, until: int, name: str) -> DataFrame:
        """The first trade after ``at`` by more than ``after`` (at least, from the second hour on) and at most ``until``."""
        near = rows.where(F.col(at).isNotNull()).withColumn("step", F.explode(F.sequence(clock.floor_div(F.col(at) + after, H), clock.floor_div(F.col(at) + until, H))))
        late = F.col("tm") >= F.col(at) + after if after else F.col("tm") > F.col(at)
        hit = near.join(t, ["market", "step"]).where(late & (F.col("tm") <= F.col(at) + until)).groupBy("event_id").agg(F.min("tm").alias(name))
        return rows.join(hit, "event_id", "left")

    x = first(first(first(d, "cp", 0, H, "trigger"), "trigger", 0, H, "fill"), "fill", 5 * H, 6 * H, "leave")
    code = F.when(F.col("trigger").isNull(), "NO_TRIGGER").when(F.col("fill").isNull(), "NO_FILL").when(F.col("leave").isNull(), "NO_EXIT").otherwise("COMPLETE")
    return x.select("event_id", code.alias("disposition"), F.coalesce(F.col("leave") - F.col("cp"), F.lit(-1).cast("long")).alias("held_ns"))


_COMPLETE = f"""e AS (SELECT market, contract, event_at_ns AS tm, open_nano AS entry, close_nano - open_nano AS overnight FROM bars WHERE event_at_ns // {H} % 24 IN (3, 9, 15, 21)), o AS (SELECT *, tm // {6 * H} AS session, tm // {D} % 2 AS fold FROM e),
p AS (SELECT o.market, o.session, o.contract, count(b.event_at_ns) AS n, max(CASE WHEN b.event_at_ns = o.tm + {2 * H} THEN b.open_nano END) - any_value(o.entry) AS move FROM o JOIN bars b ON b.market = o.market AND b.contract = o.contract AND b.event_at_ns BETWEEN o.tm AND o.tm + {2 * H} GROUP BY 1, 2, 3)"""


@query(
    f"""WITH {tables.bars_sql()}, {_COMPLETE}, s AS (SELECT market, fold, median(overnight) AS location FROM o GROUP BY 1, 2), m AS (SELECT market, fold, any_value(location) AS location, 1.4826 * median(abs(overnight - location)) AS scale FROM o JOIN s USING (market, fold) GROUP BY 1, 2),
x AS (SELECT o.market, o.session, o.fold, n = 3 AS complete, (overnight - location) / nullif(scale, 0) AS z, move, sign(overnight - location) AS side FROM o JOIN p USING (market, session, contract) JOIN m ON m.market = o.market AND m.fold = 1 - o.fold),
r AS (SELECT session, market, fold, bool_and(complete) AS complete, max(CASE WHEN complete AND abs(z) >= 0.5 THEN -side * move // 1000 ELSE 0 END) AS candidate, max(CASE WHEN complete AND abs(z) >= 0.5 THEN side * move // 1000 ELSE 0 END) AS continuation, bool_or(complete AND abs(z) >= 0.5) AS eligible FROM x GROUP BY 1, 2, 3)
SELECT session, count(*) AS markets, bool_and(complete) AND count(*) >= 4 AS in_portfolio, count(*) FILTER (eligible) AS eligible, CASE WHEN bool_and(complete) AND count(*) >= 4 THEN sum(candidate)::BIGINT ELSE 0 END AS candidate, CASE WHEN bool_and(complete) AND count(*) >= 4 THEN sum(continuation)::BIGINT ELSE 0 END AS continuation FROM r GROUP BY 1"""
)
def overnight_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-17: reversal of overnight moves that the other fold's location and scale call large, against continuation; a session counts only if at least four markets are complete in it."""
    b = tables.bars(spark, sf_dir)
    e = b.where((clock.floor_div("event_at_ns", H) % 24).isin(3, 9, 15, 21)).select("market", "contract", F.col("event_at_ns").alias("at"), F.col("open_nano").alias("entry"), (F.col("close_nano") - F.col("open_nano")).alias("overnight"), F.lit(1).cast("long").alias("direction"))
    o = e.withColumn("session", clock.floor_div("at", 6 * H)).withColumn("fold", clock.floor_div("at", D) % 2)
    held = labels.stopped_path(o, b, ["market", "contract"], H, 2, 1 << 60).withColumn("move", F.when(F.col("complete"), F.col("exit") - F.col("entry")))
    scale = ridge.robust_scale(o, ["market", "fold"], "overnight", 1).select("market", (1 - F.col("fold")).alias("fold"), "location", "scale")
    x = held.join(scale, ["market", "fold"])
    away = F.col("overnight") - F.col("location")
    ok = F.coalesce(F.col("complete") & (F.abs(away / F.nullif(F.col("scale"), F.lit(0.0))) >= 0.5), F.lit(False))
    pnl = lambda sign: F.when(ok, F.floor(sign * F.signum(away) * F.col("move") / 1000).cast("long")).otherwise(0)
    r = x.groupBy("session", "market", "fold").agg(F.bool_and("complete").alias("complete"), F.max(pnl(-1)).alias("candidate"), F.max(pnl(1)).alias("continuation"), F.bool_or(ok).alias("eligible"))
    whole = F.bool_and("complete") & (F.count("*") >= 4)
    return r.groupBy("session").agg(F.count("*").alias("markets"), whole.alias("in_portfolio"), F.count_if("eligible").alias("eligible"), F.when(whole, F.sum("candidate")).otherwise(F.lit(0).cast("long")).alias("candidate"), F.when(whole, F.sum("continuation")).otherwise(F.lit(0).cast("long")).alias("continuation"))


@query(
    f"""WITH {tables.TRADES}, c AS (SELECT event_at_ns // {6 * H} AS slot, market, max(price_nano) AS score, max(event_id) AS id FROM trades GROUP BY 1, 2), w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY slot ORDER BY score DESC, market) = 1),
o AS (SELECT event_id AS id, value AS outcome, event_id % 6 <> 1 AS path, event_id % 9 <> 2 AS features, event_id % 7 <> 3 AS baseline, event_id % 5 <> 4 AS in_risk FROM trades JOIN (SELECT event_id, value AS v FROM events) USING (event_id))
SELECT c.slot, c.market, CASE WHEN NOT features THEN 'INPUT_COVERAGE' WHEN c.score < 20000000000 THEN 'BELOW_HURDLE' WHEN NOT baseline THEN 'BASELINE_COVERAGE' WHEN NOT in_risk THEN 'RISK_CAP' WHEN w.id IS NULL THEN 'RANKED_OUT' WHEN NOT path THEN 'MISSING_PRICE_PATH' ELSE 'PLANNED' END AS disposition
FROM c JOIN o ON o.id = c.id LEFT JOIN w ON w.slot = c.slot AND w.id = c.id"""
)
def planned_before_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-11, Q-13: the winner of each slot is chosen before outcomes are looked at, and a loser isn't promoted; ordered terminal dispositions."""
    t = tables.trades(spark, sf_dir)
    c = t.groupBy(clock.floor_div("event_at_ns", 6 * H).alias("slot"), "market").agg(F.max("price_nano").alias("score"), F.max("event_id").alias("id"))
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "market"))
    ranked = c.withColumn("place", place)
    o = t.select(F.col("event_id").alias("id"), *((F.col("event_id") % n != k).alias(name) for name, n, k in (("path", 6, 1), ("features", 9, 2), ("baseline", 7, 3), ("in_risk", 5, 4))))
    code = codes.first_reason(
        (F.col("features"), "INPUT_COVERAGE"), (F.col("score") >= 20_000_000_000, "BELOW_HURDLE"), (F.col("baseline"), "BASELINE_COVERAGE"), (F.col("in_risk"), "RISK_CAP"), (F.col("place") == 1, "RANKED_OUT"), (F.col("path"), "MISSING_PRICE_PATH"))
    return ranked.join(o, "id").select("slot", "market", F.coalesce(code, F.lit("PLANNED")).alias("disposition"))


@query(
    f"""WITH {tables.TRADES}, c AS (SELECT market, event_at_ns // {D} AS day, count(*) AS n, count(*) FILTER (price_nano > 40000000000) AS priced, min(event_id) % 8 = 0 AS closed FROM trades GROUP BY 1, 2), u AS (SELECT s AS strategy, c.*, CASE s WHEN 'flat' THEN true WHEN 'feature' THEN priced > 0 WHEN 'unconditional' THEN n > 1 ELSE priced > 1 END AS has FROM c, (VALUES ('flat'), ('feature'), ('unconditional'), ('candidate')) v(s))
SELECT strategy, market, count(*) AS census, count(*) FILTER (NOT closed) AS expected, count(*) FILTER (NOT closed AND has) AS eligible, round(count(*) FILTER (NOT closed AND has) / nullif(count(*) FILTER (NOT closed), 0), 6) AS rate, CASE WHEN strategy = 'flat' THEN count(*) FILTER (NOT closed AND has) = count(*) FILTER (NOT closed) ELSE count(*) FILTER (NOT closed AND has) >= 0.95 * count(*) FILTER (NOT closed) END AS passed FROM u GROUP BY 1, 2"""
)
def strategy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-05, Q-06, Q-08: each strategy's own universe from the census, not from the candidate's; rates over what isn't closed, and flat must have all of it."""
    t = tables.trades(spark, sf_dir)
    c = t.groupBy("market", clock.floor_div("event_at_ns", D).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("price_nano") > 40_000_000_000).alias("priced"), (F.min("event_id") % 8 == 0).alias("closed"))
    own = {"flat": F.lit(True), "feature": F.col("priced") > 0, "unconditional": F.col("n") > 1, "candidate": F.col("priced") > 1}
    u = c.withColumn("s", F.explode(F.array(*(F.struct(F.lit(k).alias("strategy"), v.alias("has")) for k, v in own.items())))).select("market", "closed", "s.*")
    open_, ok = F.count_if(~F.col("closed")), F.count_if(~F.col("closed") & F.col("has"))
    passed = F.when(F.col("strategy") == "flat", ok == open_).otherwise(ok >= F.lit(0.95) * open_)
    return u.groupBy("strategy", "market").agg(F.count("*").alias("census"), open_.alias("expected"), ok.alias("eligible"), F.round(ok / F.nullif(open_, F.lit(0)), 6).alias("rate"), passed.alias("passed"))


@query(
    """WITH r AS (SELECT p_type AS market, p_partkey % 19 <> 3 AS eligible, p_partkey % 41 <> 7 AS available FROM part), m AS (SELECT market, count(*) AS open, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND available) AS available FROM r GROUP BY 1)
SELECT market, open, eligible, available, eligible >= 0.9 * open AS eligible_ok, available >= 0.9 * eligible AS available_ok, (SELECT sum(eligible) >= 0.95 * sum(open) AND sum(available) >= 0.99 * sum(eligible) FROM m) AND (SELECT bool_and(eligible >= 0.9 * open AND available >= 0.9 * eligible) FROM m) AS passed FROM m"""
)
def model_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-03: shares of eligible and of available predictions, overall and in each market; all must hold."""
    k = F.col("p_partkey")
    m = tables.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("market")).agg(F.count("*").alias("open"), F.count_if(k % 19 != 3).alias("eligible"), F.count_if((k % 19 != 3) & (k % 41 != 7)).alias("available"))
    m = m.withColumns({"eligible_ok": F.col("eligible") >= F.lit(0.9) * F.col("open"), "available_ok": F.col("available") >= F.lit(0.9) * F.col("eligible")})
    total = m.agg((F.sum("eligible") >= F.lit(0.95) * F.sum("open")).alias("a"), (F.sum("available") >= F.lit(0.99) * F.sum("eligible")).alias("b"), F.bool_and(F.col("eligible_ok") & F.col("available_ok")).alias("c"))
    return m.join(F.broadcast(total)).select("market", "open", "eligible", "available", "eligible_ok", "available_ok", (F.col("a") & F.col("b") & F.col("c")).alias("passed"))  # one row of totals


@query(
    f"""WITH {tables.TRADES}, f AS (SELECT market, event_at_ns AS tm, event_id % 12 = 0 AS defect FROM trades), c AS (SELECT DISTINCT market, event_at_ns // {8 * H} * {8 * H} AS cp FROM trades), j AS (SELECT c.market, c.cp, count(*) AS rows, count(*) FILTER (defect AND tm < c.cp) AS before_n, count(*) FILTER (defect AND tm >= c.cp) AS after_n FROM c JOIN f ON f.market = c.market AND f.tm >= c.cp - {2 * H} AND f.tm < c.cp + {3 * H} GROUP BY 1, 2)
SELECT c.market, c.cp AS checkpoint_ns, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'NO_ROWS' WHEN before_n > 0 AND after_n > 0 THEN 'BOTH_DEFECTIVE' WHEN before_n > 0 THEN 'FEATURES_DEFECTIVE' WHEN after_n > 0 THEN 'PATH_DEFECTIVE' ELSE 'CLEAN' END AS state FROM c LEFT JOIN j USING (market, cp)"""
)
def checkpoint_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-07, Q-12, Q-29: a defective row matters only to the checkpoints whose window holds it; counts by role."""
    t = tables.trades(spark, sf_dir)
    c = t.select("market", clock.floor_to("event_at_ns", 8 * H).alias("cp")).distinct()
    cps = F.array(clock.floor_to("tm", 8 * H), clock.floor_to("tm", 8 * H) + 8 * H)
    f = t.select("market", F.col("event_at_ns").alias("tm"), (F.col("event_id") % 12 == 0).alias("defect")).withColumn("cp", F.explode(cps)).where((F.col("tm") >= F.col("cp") - 2 * H) & (F.col("tm") < F.col("cp") + 3 * H))
    early = F.col("tm") < F.col("cp")
    g = f.groupBy("market", "cp").agg(F.count("*").alias("rows"), F.bool_or(F.col("defect") & early).alias("a"), F.bool_or(F.col("defect") & ~early).alias("b"))
    state = F.when(F.col("rows").isNull(), "NO_ROWS").when(F.col("a") & F.col("b"), "BOTH_DEFECTIVE").when(F.col("a"), "FEATURES_DEFECTIVE").when(F.col("b"), "PATH_DEFECTIVE").otherwise("CLEAN")
    return c.join(g, ["market", "cp"], "left").select("market", F.col("cp").alias("checkpoint_ns"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), state.alias("state"))


@query(
    """WITH w AS (SELECT user_id % 200 AS instrument, max(epoch_us(ts)) FILTER (event_id % 3 = 0) AS completed, max(epoch_us(ts)) AS pending FROM events GROUP BY 1) SELECT instrument, coalesce(completed, -1) AS watermark_us, greatest(1705708800000000, coalesce(completed, 0)) AS replay_from_us, completed IS NOT NULL AND pending > completed AS behind FROM w"""
)
def instrument_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-06: a finished replay's position is the instrument's watermark; the next one begins there, but not before the earliest that may be asked for."""
    at = F.unix_micros("ts")
    w = tables.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 200).alias("instrument")).agg(F.max(F.when(F.col("event_id") % 3 == 0, at)).alias("done"), F.max(at).alias("pending"))
    return w.select("instrument", F.coalesce("done", F.lit(-1).cast("long")).alias("watermark_us"), F.greatest(F.lit(1705708800000000), F.coalesce("done", F.lit(0).cast("long"))).alias("replay_from_us"), (F.col("done").isNotNull() & (F.col("pending") > F.col("done"))).alias("behind"))


@query(
    f"""WITH {tables.TRADES}, b AS (SELECT instrument_id % 60 AS instrument, event_at_ns // {H} AS k, sum(price_nano)::BIGINT AS v, event_id % 2 AS live FROM trades GROUP BY 1, 2, event_id % 2), c AS (SELECT instrument, max(k) AS covered FROM b WHERE live = 0 GROUP BY 1)
SELECT instrument, k AS hour_no, arg_min(v, CASE WHEN live = 0 THEN 0 ELSE 1 END) AS v, min(live) = 0 AS from_history, k > coalesce(any_value(covered), -1) AS beyond_history FROM b LEFT JOIN c USING (instrument) GROUP BY 1, 2"""
)
def replay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-07: history merged into live bars; where both have one, history wins, and live goes on where history ends."""
    t = tables.trades(spark, sf_dir)
    b = t.groupBy((F.col("instrument_id") % 60).alias("instrument"), clock.floor_div("event_at_ns", H).alias("hour_no"), (F.col("event_id") % 2).alias("live")).agg(F.sum("price_nano").alias("v"))
    one = b.groupBy("instrument", "hour_no").agg(F.min_by("v", "live").alias("v"), (F.min("live") == 0).alias("from_history"))
    covered = b.where("live = 0").groupBy("instrument").agg(F.max("hour_no").alias("covered"))
    return one.join(covered, "instrument", "left").select("instrument", "hour_no", "v", "from_history", (F.col("hour_no") > F.coalesce("covered", F.lit(-1).cast("long"))).alias("beyond_history"))


@query(
    """WITH r AS (SELECT n_regionkey AS market, 2018 + n_nationkey % 3 AS year, n_nationkey AS release, n_nationkey % 7 AS rank, n_nationkey % 11 = 4 AS ambiguous, 10 AS expected, 10 - (n_nationkey % 13 = 5)::INT AS feature_n, 10 - (n_nationkey % 5 = 3)::INT AS execution_n FROM nation)
SELECT market, year, release, NOT ambiguous AND feature_n = expected AND execution_n = expected AND least(feature_n, execution_n) = expected AS certified, concat_ws(',', CASE WHEN ambiguous THEN 'AMBIGUOUS' END, CASE WHEN execution_n <> expected THEN 'EXECUTION' END, CASE WHEN feature_n <> expected THEN 'FEATURE' END) AS reasons FROM r QUALIFY row_number() OVER (PARTITION BY market, year ORDER BY rank, release) = 1"""
)
def certified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-25, Q-31: of each market and year the release of the lowest rank, certified only if nothing is ambiguous and all windows are whole."""
    k = F.col("n_nationkey")
    r = tables.table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("market"), (k % 3 + 2018).alias("year"), k.alias("release"), (k % 7).alias("rank"), (k % 11 == 4).alias("ambiguous"), (10 - (k % 13 == 5).cast("int")).alias("feature_n"), (10 - (k % 5 == 3).cast("int")).alias("execution_n"))
    best = r.groupBy("market", "year").agg(F.min_by(F.struct("release", "ambiguous", "feature_n", "execution_n"), F.struct("rank", "release")).alias("b")).select("market", "year", "b.*")
    reasons = codes.reasons((~F.col("ambiguous"), "AMBIGUOUS"), (F.col("feature_n") == 10, "FEATURE"), (F.col("execution_n") == 10, "EXECUTION"))
    return best.select("market", "year", "release", (F.size(reasons) == 0).alias("certified"), F.array_join(reasons, ",").alias("reasons"))


@query(
    f"""WITH {tables.TRADES}, l AS (SELECT event_id, market, event_at_ns // {2 * H} AS k, instrument_id % 3 AS meaning FROM trades), w AS (SELECT *, lag(k) OVER (PARTITION BY market ORDER BY event_id) AS pk, lag(meaning) OVER (PARTITION BY market ORDER BY event_id) AS pm FROM l)
SELECT market, count(*) AS rows, count(*) FILTER (pk = k AND pm = meaning) AS exact_repeats, count(*) FILTER (pk = k AND pm <> meaning) AS conflicting_repeats FROM w GROUP BY 1"""
)
def definition_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-26: consecutive rows of one key, told apart by what they mean."""
    t = tables.trades(spark, sf_dir).select("event_id", "market", clock.floor_div("event_at_ns", 2 * H).alias("k"), (F.col("instrument_id") % 3).alias("meaning"))
    was = F.lag(F.struct("k", "meaning")).over(Window.partitionBy("market").orderBy("event_id"))
    w = t.withColumn("was", was)
    same = F.col("was.k") == F.col("k")
    return w.groupBy("market").agg(F.count("*").alias("rows"), F.count_if(same & (F.col("was.meaning") == F.col("meaning"))).alias("exact_repeats"), F.count_if(same & (F.col("was.meaning") != F.col("meaning"))).alias("conflicting_repeats"))


_SCENARIOS = ((0, 0), (1, 20), (2, 45))


@query(
    """WITH r AS (SELECT user_id % 40 AS strategy, s AS scenario, round(sum(value) - c * count(*), 4) AS net, round(avg(value) - c, 6) AS mean FROM events, (VALUES (0, 0), (1, 20), (2, 45)) v(s, c) GROUP BY 1, 2, c), w AS (SELECT strategy, max(net) FILTER (scenario = 0) AS base, max(net) FILTER (scenario = 1) AS stress, max(net) FILTER (scenario = 2) AS severe, min(mean) AS worst_mean FROM r GROUP BY 1)
SELECT strategy, base >= stress AND stress >= severe AS monotone, base > 0 AS base_positive, stress > 0 AS stress_positive, severe > 0 AS severe_positive, CASE WHEN base > 0 AND stress > 0 AND worst_mean > -5 THEN 'PASS' ELSE 'FAIL' END AS gate FROM w"""
)
def cost_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-12: results fall as costs rise, and the gates that follow from all scenarios together."""
    e = tables.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("strategy")).agg(F.sum("value").alias("v"), F.count("*").alias("n"), F.avg("value").alias("m"))
    net = [F.round(F.col("v") - c * F.col("n"), 4) for _, c in _SCENARIOS]
    worst = F.round(F.col("m") - max(c for _, c in _SCENARIOS), 6)
    return e.select("strategy", ((net[0] >= net[1]) & (net[1] >= net[2])).alias("monotone"), *((x > 0).alias(f"{n}_positive") for x, n in zip(net, ("base", "stress", "severe"), strict=True)), F.when((net[0] > 0) & (net[1] > 0) & (worst > -5), "PASS").otherwise("FAIL").alias("gate"))


@query(
    f"""WITH {tables.bars_sql()}, p AS (SELECT market, event_at_ns, min(close_nano) AS c, min(volume) AS v FROM bars GROUP BY 1, 2), l AS (SELECT *, row_number() OVER w AS i, c::DOUBLE / lag(c) OVER w - 1 AS r1, c::DOUBLE / lag(c, 5) OVER w - 1 AS r5, c::DOUBLE / lag(c, 20) OVER w - 1 AS r20, ln(c::DOUBLE / lag(c) OVER w) AS lr FROM p WINDOW w AS (PARTITION BY market ORDER BY event_at_ns)),
f AS (SELECT *, stddev_pop(lr) OVER w20 AS vol20, avg(v) OVER w60 AS vm, stddev_pop(v) OVER w60 AS vs FROM l WINDOW w20 AS (PARTITION BY market ORDER BY event_at_ns ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY market ORDER BY event_at_ns ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT market, event_at_ns, round(r1, 8) AS return_1, round(r5, 8) AS return_5, round(r20, 8) AS return_20, round(vol20, 8) AS volatility, round(ln(1 + v), 8) AS log_volume, CASE WHEN vs > 0 THEN round((v - vm) / vs, 8) ELSE 0 END AS volume_z, CASE WHEN vs > 0 THEN 'READY' ELSE 'NO_VOLUME_VARIANCE' END AS state FROM f WHERE i >= 61"""
)
def reported_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-16: features over the last 61 reported bars by their order, never by filling gaps; a window without variance of volume says so."""
    p = tables.bars(spark, sf_dir).groupBy("market", "event_at_ns").agg(F.min("close_nano").alias("c"), F.min("volume").alias("v"))
    p = windows.overlapping(scans.numbered(p, ["market"], ["event_at_ns"], "i", 1_000 * H), "i", 10_000, 61)
    w = Window.partitionBy("market", "_bucket").orderBy("event_at_ns")
    ret = lambda k: F.round(F.col("c") / F.lag("c", k).over(w) - 1, 8).alias(f"return_{k}")
    x = p.select("*", *map(ret, (1, 5, 20)), F.log(F.col("c") / F.lag("c").over(w)).alias("lr"))
    last = lambda n: w.rowsBetween(1 - n, 0)
    x = x.withColumns({"volatility": F.round(F.stddev_pop("lr").over(last(20)), 8), "vm": F.avg("v").over(last(60)), "vs": F.stddev_pop("v").over(last(60))}).where("i >= 61 and _own")
    z = F.when(F.col("vs") > 0, F.round((F.col("v") - F.col("vm")) / F.nullif(F.col("vs"), F.lit(0.0)), 8)).otherwise(0.0)
    return x.select("market", "event_at_ns", "return_1", "return_5", "return_20", "volatility", F.round(F.log1p("v"), 8).alias("log_volume"), z.alias("volume_z"), F.when(F.col("vs") > 0, "READY").otherwise("NO_VOLUME_VARIANCE").alias("state"))

