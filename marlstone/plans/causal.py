"""Queries on what could be known when: definitions, statistics, identities, quotes, leak guards and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, codes
from ..operators import labels, pointintime, scans
from . import tables
from .registry import query

H, D = clock.HOUR, clock.DAY
_INSTRUMENT, _DAY = "instrument_id % 40", f"event_at_ns // {D}"

_LOG = f"""log AS (SELECT {_INSTRUMENT} AS instrument, {_DAY} AS day, event_at_ns // {H} * {H} AS received_ns, market AS file, event_id AS ordinal,
  CASE WHEN event_id % 97 = 5 THEN 'OTHER' WHEN event_id % 11 = 0 THEN 'DELETE' WHEN event_id % 3 = 0 THEN 'MODIFY' ELSE 'ADD' END AS action, CASE WHEN event_id % 13 = 4 THEN 'SPREAD' ELSE 'FUTURE' END AS class,
  event_at_ns // {H} * {H} - (event_id % 4) * {H} AS active_ns, event_at_ns // {H} * {H} + (2 + event_id % 9) * {H} AS expired_ns, event_id % 5 AS multiplier FROM trades WHERE event_id % 3 <> 1),
b AS (SELECT event_id, {_INSTRUMENT} AS instrument, {_DAY} AS day, event_at_ns, event_at_ns + {2 * H} AS decided_ns FROM trades WHERE event_id % 3 = 1)"""


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A log of definitions with ties, deletes and unknown actions, and bars that need them."""
    t = tables.trades(spark, sf_dir).withColumns({"instrument": F.col("instrument_id") % 40, "day": clock.floor_div("event_at_ns", D), "received_ns": clock.floor_to("event_at_ns", H)})
    i = F.col("event_id")
    action = F.when(i % 97 == 5, "OTHER").when(i % 11 == 0, "DELETE").when(i % 3 == 0, "MODIFY").otherwise("ADD")
    log = t.where("event_id % 3 <> 1").select(
        "instrument", "day", "received_ns", F.col("market").alias("file"), i.alias("ordinal"), action.alias("action"), F.when(i % 13 == 4, "SPREAD").otherwise("FUTURE").alias("class"),
        (F.col("received_ns") - (i % 4) * H).alias("active_ns"), (F.col("received_ns") + (2 + i % 9) * H).alias("expired_ns"), (i % 5).alias("multiplier"))
    return log, t.where("event_id % 3 = 1").select("event_id", "instrument", "day", "event_at_ns", (F.col("event_at_ns") + 2 * H).alias("decided_ns"))


REPLAY = f"""WITH {tables.TRADES}, {_LOG}, j AS (SELECT b.event_id, b.event_at_ns, count(l.ordinal) FILTER (l.received_ns <= b.event_at_ns) AS n, coalesce(bool_or(l.action = 'OTHER') FILTER (l.received_ns <= b.event_at_ns), false) AS odd,
  count(l.ordinal) FILTER (l.received_ns > b.event_at_ns AND l.received_ns <= b.decided_ns) AS later,
  list_sort(list({{'r': l.received_ns, 'f': l.file, 'o': l.ordinal, 'action': l.action, 'class': l.class, 'a': l.active_ns, 'e': l.expired_ns, 'm': l.multiplier}}) FILTER (l.received_ns <= b.event_at_ns))[-1] AS s
  FROM b LEFT JOIN log l ON l.instrument = b.instrument AND l.day = b.day GROUP BY b.event_id, b.event_at_ns),
c AS (SELECT event_id, s.m AS m, CASE WHEN n = 0 THEN 'NO_DEFINITION_BY_START' WHEN odd THEN 'UNKNOWN_ACTION' WHEN s.action = 'DELETE' THEN 'DELETED' WHEN s.class <> 'FUTURE' THEN 'NOT_OUTRIGHT'
  WHEN s.a > event_at_ns OR s.e <= event_at_ns THEN 'NOT_ACTIVE' WHEN later > 0 THEN 'CHANGED_BEFORE_DECISION' ELSE 'RESOLVED' END AS code FROM j)
SELECT event_id, code, CASE WHEN code = 'RESOLVED' THEN m ELSE -1 END AS multiplier FROM c"""


@query(REPLAY)
def definition_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-01: each bar's definition of its UTC date, replayed with deletes; equal times in the order of file and ordinal."""
    log, bars = _log(spark, sf_dir)
    found = pointintime.definition_of(bars, log, ["instrument", "day"], "event_at_ns", "decided_ns", ["file", "ordinal"], ["multiplier"])
    return found.select("event_id", "code", F.coalesce("multiplier", F.lit(-1).cast("long")).alias("multiplier"))


@query(
    f"""WITH {tables.TRADES}, {_LOG}, s AS (SELECT instrument, day, ordinal % 3 AS kind, received_ns, file, ordinal, CASE WHEN ordinal % 97 = 5 THEN 'OTHER' WHEN ordinal % 7 = 0 THEN 'DELETE' ELSE 'NEW' END AS action,
  CASE WHEN ordinal % 17 = 3 THEN {pointintime.NO_VALUE} ELSE ordinal * 1000 END AS price, CASE WHEN ordinal % 19 = 3 THEN {pointintime.NO_VALUE} ELSE ordinal % 50 END AS quantity FROM log),
q AS (SELECT b.event_id, k.kind, list_sort(list({{'r': s.received_ns, 'f': s.file, 'o': s.ordinal, 'action': s.action, 'p': s.price, 'q': s.quantity}}) FILTER (s.received_ns <= b.event_at_ns))[-1] AS s
  FROM b CROSS JOIN (VALUES (0), (1), (2)) k(kind) LEFT JOIN s ON s.instrument = b.instrument AND s.day = b.day AND s.kind = k.kind GROUP BY 1, 2),
c AS (SELECT event_id, kind, s, CASE WHEN s IS NULL THEN 'UNRESOLVED' WHEN s.action = 'DELETE' THEN 'DELETED' WHEN s.action <> 'NEW' THEN 'UNKNOWN_UPDATE_ACTION' WHEN s.p = {pointintime.NO_VALUE} OR s.q = {pointintime.NO_VALUE} THEN 'NEW_UNKNOWN_VALUE'
  WHEN kind < 2 THEN 'NEW_KNOWN' ELSE 'NEW_UNDECLARED_ROLE' END AS state FROM q)
SELECT event_id, kind::BIGINT AS kind, state, CASE WHEN state IN ('NEW_KNOWN', 'NEW_UNDECLARED_ROLE') THEN s.p ELSE -1 END AS price_nano, CASE WHEN state IN ('NEW_KNOWN', 'NEW_UNDECLARED_ROLE') THEN s.q ELSE -1 END AS quantity FROM c"""
)
def statistics_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-03, A-15: the state of each kind of statistic by the decision, with deletes and values that are none."""
    log, bars = _log(spark, sf_dir)
    i, none = F.col("ordinal"), F.lit(pointintime.NO_VALUE)
    stats = log.select(
        "instrument", "day", (i % 3).alias("kind"), "received_ns", "file", "ordinal", F.when(i % 97 == 5, "OTHER").when(i % 7 == 0, "DELETE").otherwise("NEW").alias("action"),
        F.when(i % 17 == 3, none).otherwise(i * 1000).alias("price_nano"), F.when(i % 19 == 3, none).otherwise(i % 50).alias("quantity"))
    asked = bars.select("event_id", "instrument", "day", "event_at_ns", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("kind"))
    found = pointintime.statistic_of(asked, stats, ["instrument", "day", "kind"], "event_at_ns", ["file", "ordinal"], F.col("kind") < 2)
    return found.select("event_id", "kind", "state", *(F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("price_nano", "quantity")))


@query(
    f"""WITH {tables.TRADES}, {_LOG}, v AS (SELECT b.event_id, b.event_at_ns, l.*, l.received_ns <= b.event_at_ns AND l.received_ns + (l.ordinal % 3) * {H // 2} <= b.event_at_ns AS ok FROM b JOIN
  (SELECT * REPLACE (CASE WHEN ordinal % 3 = 0 THEN 'x' ELSE 'y' END AS file, ordinal % 2 AS multiplier, 'FUTURE' AS class, day * {D} AS active_ns, (day + 1) * {D} AS expired_ns, CASE WHEN action = 'DELETE' THEN action ELSE 'ADD' END AS action) FROM log) l
  ON l.instrument = b.instrument AND l.day = b.day WHERE l.received_ns + (l.ordinal % 3) * {H // 2} <= b.decided_ns),
last AS (SELECT event_id, max(received_ns) AS r FROM v WHERE ok GROUP BY 1),
told AS (SELECT v.event_id, v.file, list({{'a': action, 'm': multiplier}} ORDER BY ordinal) AS told, arg_max(action, ordinal) AS action, arg_max(multiplier, ordinal) AS m FROM v JOIN last ON v.event_id = last.event_id AND v.received_ns = last.r AND v.ok GROUP BY 1, 2),
t AS (SELECT event_id, count(DISTINCT told) AS stories, arg_min(action, file) AS action, arg_min(m, file) AS m FROM told GROUP BY 1),
c AS (SELECT b.event_id, t.m, CASE WHEN t.event_id IS NULL THEN 'NO_DEFINITION_BY_START' WHEN stories > 1 THEN 'CONFLICTING_FILES' WHEN EXISTS (SELECT 1 FROM v WHERE v.event_id = b.event_id AND NOT ok) THEN 'CHANGED_BEFORE_DECISION'
  WHEN t.action = 'DELETE' THEN 'NOT_AN_ACTIVE_FUTURE' ELSE 'RESOLVED' END AS code FROM b LEFT JOIN t USING (event_id))
SELECT event_id, code, CASE WHEN code = 'RESOLVED' THEN m ELSE -1 END AS multiplier FROM c"""
)
def bar_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-07: each bar's contract from observations that were received and available, with tied files and changes until the decision."""
    log, bars = _log(spark, sf_dir)
    i = F.col("ordinal")
    seen = log.withColumns({
        "available_ns": F.col("received_ns") + (i % 3) * (H // 2), "file": F.when(i % 3 == 0, "x").otherwise("y"), "multiplier": i % 2, "class": F.lit("FUTURE"), "active_ns": F.col("day") * D, "expired_ns": (F.col("day") + 1) * D,
        "action": F.when(F.col("action") == "DELETE", "DELETE").otherwise("ADD")})
    found = pointintime.identity_of(bars, seen, ["instrument", "day"], "event_at_ns", "decided_ns", ["multiplier"])
    return found.select("event_id", "code", F.coalesce("multiplier", F.lit(-1).cast("long")).alias("multiplier"))


@query(
    f"""WITH {tables.TRADES}, t AS (SELECT event_id, market, instrument_id % 3 AS own, event_at_ns AS s, event_at_ns + {H} AS e FROM trades WHERE event_id % 4 = 0), q AS (SELECT market, event_at_ns + {H // 10} AS a, event_id AS o, instrument_id % 3 AS i FROM trades WHERE event_id % 7 < 2),
j AS (SELECT t.event_id, min(struct_pack(a := q.a, o := q.o)) AS f, bool_or(q.i <> t.own) AS foreign_one FROM t JOIN q ON q.market = t.market AND q.a >= t.s AND q.a <= t.e GROUP BY 1)
SELECT t.event_id, CASE WHEN j.f IS NULL THEN 'NO_QUOTE_BY_DEADLINE' WHEN foreign_one THEN 'FOREIGN_INSTRUMENT' ELSE 'COMPLETE' END AS state, CASE WHEN NOT foreign_one THEN j.f.o ELSE -1 END AS ordinal FROM t LEFT JOIN j USING (event_id)"""
)
def quote_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-08: the first quote from the action to the deadline, never one before; a foreign instrument spoils the target."""
    t = tables.trades(spark, sf_dir)
    targets = t.where("event_id % 4 = 0").select("event_id", "market", (F.col("instrument_id") % 3).alias("own"), "event_at_ns", (F.col("event_at_ns") + H).alias("deadline_ns"))
    quotes = t.where("event_id % 7 < 2").select("market", (F.col("event_at_ns") + H // 10).alias("available_ns"), F.col("event_id").alias("ordinal"), (F.col("instrument_id") % 3).alias("instrument_id"))
    found = pointintime.first_quote(targets, quotes, ["market"], "event_at_ns", "deadline_ns", "own", H)
    return found.select("event_id", "state", F.coalesce("ordinal", F.lit(-1).cast("long")).alias("ordinal"))


@query(
    f"""WITH {tables.TRADES}, t AS (SELECT event_id, market, event_at_ns + (CASE event_id % 3 WHEN 1 THEN 60 WHEN 2 THEN 0 ELSE 0 END) * {clock.MINUTE} AS s, event_at_ns + (CASE event_id % 3 WHEN 0 THEN 1 ELSE 91 END) * {clock.MINUTE} AS e,
  CASE event_id % 3 WHEN 0 THEN 'ENTRY' WHEN 1 THEN 'LIQUIDATION' ELSE 'BOTH' END AS category FROM trades WHERE event_id % 5 = 0 AND event_id % 2 = 1),
o AS (SELECT market, event_at_ns AS tm, instrument_id % 2 AS i, event_id % 3 AS family FROM trades), j AS (SELECT t.event_id, o.family, count(*) AS n, count(DISTINCT o.i) AS ids, min(tm - s) AS first_offset FROM t JOIN o ON o.market = t.market AND o.tm >= t.s AND o.tm < t.e GROUP BY 1, 2)
SELECT t.event_id, category, CASE WHEN max(ids) > 1 THEN 'AMBIGUOUS_FAIL_CLOSED' WHEN max(ids) = 1 THEN 'RECOVERY_CANDIDATE' ELSE 'NOT_OBSERVED' END AS disposition, coalesce(sum(n), 0)::BIGINT AS observed, coalesce(min(first_offset), -1) AS first_offset_ns, count(DISTINCT family) AS families
FROM t LEFT JOIN j USING (event_id) GROUP BY 1, 2"""
)
def gap_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-23: checkpoints whose features are complete and whose execution isn't, as windows of entry, liquidation or both; what each source shows there."""
    t = tables.trades(spark, sf_dir)
    kind, at = F.col("event_id") % 3, F.col("event_at_ns")
    m = clock.MINUTE
    failed = t.where("event_id % 5 = 0 and event_id % 2 = 1").select(
        "event_id", "market", F.when(kind == 0, "ENTRY").when(kind == 1, "LIQUIDATION").otherwise("BOTH").alias("category"),
        F.when(kind == 1, at + 60 * m).otherwise(at).alias("s"), F.when(kind == 0, at + m).otherwise(at + 91 * m).alias("e"))
    step = lambda c: F.floor(c / H).cast("long")
    dealt = failed.withColumn("step", F.explode(F.sequence(step(F.col("s")), step(F.col("e") - 1))))
    seen = t.select("market", at.alias("at"), (F.col("instrument_id") % 2).alias("i"), kind.alias("family"), step(at).alias("step"))
    inside = dealt.join(seen, ["market", "step"]).where("at >= s and at < e")
    families = inside.groupBy("event_id", "family").agg(F.count("*").alias("n"), F.count_distinct("i").alias("ids"), F.min(F.col("at") - F.col("s")).alias("first_offset"))
    found = families.groupBy("event_id").agg(F.max("ids").alias("ids"), F.sum("n").alias("n"), F.min("first_offset").alias("first_offset"), F.count("*").alias("families"))
    state = F.when(F.col("ids") > 1, "AMBIGUOUS_FAIL_CLOSED").when(F.col("ids") == 1, "RECOVERY_CANDIDATE").otherwise("NOT_OBSERVED")
    zero = lambda c, other: F.coalesce(c, F.lit(other).cast("long")).alias(c)
    out = failed.join(found, "event_id", "left").select("event_id", "category", state.alias("disposition"), zero("n", 0), zero("first_offset", -1), zero("families", 0))
    return out.withColumnsRenamed({"n": "observed", "first_offset": "first_offset_ns"})


_ROLES = (
    ("decided < entry", "ENTRY_NOT_STRICTLY_AFTER_DECISION"), ("feature_end <= decided", "FEATURE_USES_POST_DECISION_DATA"), ("label_start = entry", "LABEL_START_DOES_NOT_MATCH_ENTRY"),
    ("return_start = entry and pnl_start = entry", "EXECUTION_START_DOES_NOT_MATCH_ENTRY"), ("return_end = label_end and pnl_end = label_end", "EXECUTION_END_DOES_NOT_MATCH_LABEL"),
    ("return_start = pnl_start and return_end = pnl_end", "EXECUTION_INTERVAL_MISMATCH"))
_WINDOWS = {
    "decided": "event_id", "entry": "event_id + event_id % 6", "feature_end": "event_id + event_id % 5 - 3", "label_start": "event_id + event_id % 6 + case when event_id % 11 = 0 then 1 else 0 end",
    "return_start": "event_id + event_id % 6", "pnl_start": "event_id + event_id % 6 + case when event_id % 13 = 0 then 1 else 0 end", "label_end": "event_id + 100",
    "return_end": "event_id + 100 + case when event_id % 17 = 0 then 1 else 0 end", "pnl_end": "event_id + 100"}


@query(
    f"""WITH w AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _WINDOWS.items())} FROM events)
SELECT event_id, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN NOT ({ok}) THEN '{code}' END" for ok, code in _ROLES)}], lambda x: x IS NOT NULL)), ',') AS reasons FROM w"""
)
def interval_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-19: the windows of features, label, return and profit against decision and entry; all reasons, sorted."""
    w = tables.table(spark, sf_dir, "events").select("event_id", *(F.expr(e).alias(n) for n, e in _WINDOWS.items()))
    return w.select("event_id", F.array_join(codes.reasons(*((F.expr(ok), code) for ok, code in _ROLES)), ",").alias("reasons"))


# Names that features must not have.
FORBIDDEN = ("target", "label", "outcome", "future_return", "realized_outcome", "exit_price", "label_end_at", "matured_status")
FORBIDDEN_PREFIXES = ("target_", "label_", "outcome_", "future_")
FORBIDDEN_ROLLS = ("bars_until_roll", "bars_to_roll", "next_roll_at", "realized_roll_at", "realized_roll_boundary", "roll_end_at", "roll_interval_end")
_NAMES = ("bar_return", "Label", "range_20", "target_x", "2nd", "roll_end_at", "volume z", "FUTURE_high", "atr")


@query(
    f"""WITH f AS (SELECT event_id // 4 AS row_id, [{', '.join(f"'{n}'" for n in _NAMES)}][least(event_id % 27, 8)::INT + 1] AS name, CASE WHEN event_id % 19 = 0 THEN 'nan'::DOUBLE WHEN event_id % 23 = 0 THEN 'inf'::DOUBLE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS value,
  event_id + event_id % 5 AS available, event_id // 4 * 4 + 5 AS decided, event_id % 31 <> 0 AS same_contract, event_id % 37 <> 0 AS allowed FROM events),
c AS (SELECT *, CASE WHEN lower(name) IN ({', '.join(f"'{n}'" for n in FORBIDDEN + FORBIDDEN_ROLLS)}) OR regexp_matches(lower(name), '^({'|'.join(FORBIDDEN_PREFIXES)})') THEN 'FORBIDDEN_NAME' WHEN NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') THEN 'INVALID_NAME'
  WHEN isnan(value) OR isinf(value) THEN 'NOT_FINITE' WHEN available > decided THEN 'LATER_THAN_DECISION' WHEN NOT allowed THEN 'FOREIGN_RELEASE' WHEN NOT same_contract THEN 'OTHER_CONTRACT' END AS code FROM f)
SELECT row_id, count(*) AS features, max(available) AS available_max, coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS codes, count(code) = 0 AND max(available) <= any_value(decided) AS accepted FROM c GROUP BY 1"""
)
def feature_row_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-13: rows of features by name: none that looks like an outcome, none that isn't finite, none known only later or of another release or contract."""
    i = F.col("event_id")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    f = tables.table(spark, sf_dir, "events").select(
        clock.floor_div("event_id", 4).alias("row_id"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.least(i % 27, F.lit(8)) + 1).cast("int")).alias("name"),
        F.when(i % 19 == 0, nan).when(i % 23 == 0, inf).when(i % 29 == 0, None).otherwise(F.col("value")).alias("value"),
        (i + i % 5).alias("available"), (clock.floor_div("event_id", 4) * 4 + 5).alias("decided"), (i % 31 != 0).alias("same_contract"), (i % 37 != 0).alias("allowed"))
    low = F.lower("name")
    outcome = low.isin(*FORBIDDEN, *FORBIDDEN_ROLLS)
    for prefix in FORBIDDEN_PREFIXES:
        outcome = outcome | low.startswith(prefix)
    code = codes.first_reason(
        (~outcome, "FORBIDDEN_NAME"), (F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "INVALID_NAME"), (F.col("value").isNull() | ~(F.isnan("value") | (F.abs("value") == inf)), "NOT_FINITE"),
        (F.col("available") <= F.col("decided"), "LATER_THAN_DECISION"), (F.col("allowed"), "FOREIGN_RELEASE"), (F.col("same_contract"), "OTHER_CONTRACT"))
    found = f.withColumn("code", code).groupBy("row_id").agg(
        F.count("*").alias("features"), F.max("available").alias("available_max"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"), ((F.count("code") == 0) & (F.max("available") <= F.max("decided"))).alias("accepted"))
    return found.select("row_id", "features", "available_max", "codes", "accepted")


_TICK, _TICK_CENTS, _FEE, _HOLD, _PATH = 10_000_000, 125, 210, 6 * H, 14 * H
_COSTS = (("base", 2), ("stress", 4), ("severe", 6))


def _fill_sql(net_target: bool, liquidation: bool) -> str:
    """Fills by a join of each decision with the bars of its path, ranked."""
    target = f"2 * planned + t * {_TICK_CENTS} // 2 + {_FEE}" if net_target else f"2 * planned + 2 * {_FEE}"
    close_at = f"least(entry_at + {_HOLD}, entry_at // {D} * {D} + {20 * H})" if liquidation else f"entry_at + {_HOLD}"
    why = f"CASE WHEN entry_at // {D} * {D} + {20 * H} <= entry_at + {_HOLD} THEN 'SESSION_LIQUIDATION' ELSE 'TIMEOUT' END" if liquidation else "'TIMEOUT'"
    costs = ", ".join(f"('{n}', {t})" for n, t in _COSTS)
    return f"""WITH {tables.bars_sql()}, e AS (SELECT market, contract, event_at_ns AS entry_at, open_nano AS o, CASE WHEN open_nano // 1000 % 2 = 0 THEN 1 ELSE -1 END AS d, high_nano - low_nano + {_TICK} AS atr FROM bars WHERE open_nano > 0),
s AS (SELECT *, (3 * atr + 2 * {_TICK} - 1) // (2 * {_TICK}) AS stop_ticks FROM e CROSS JOIN (VALUES {costs}) c(scenario, t)), p AS (SELECT *, (stop_ticks + t) * {_TICK_CENTS} + 2 * {_FEE} AS planned, o + d * t * {_TICK} // 2 AS entry FROM s),
q AS (SELECT *, entry - d * stop_ticks * {_TICK} AS stop, entry + d * (({target} + {_TICK_CENTS} - 1) // {_TICK_CENTS}) * {_TICK} AS target, {close_at} AS close_at, {why} AS why FROM p),
x AS (SELECT q.*, b.event_at_ns AS tm, CASE WHEN b.event_at_ns >= close_at THEN why WHEN d * (b.open_nano - stop) <= 0 THEN 'STOP_GAP' WHEN (d > 0 AND b.low_nano <= stop) OR (d < 0 AND b.high_nano >= stop) THEN 'STOP'
  WHEN (d > 0 AND b.high_nano >= target) OR (d < 0 AND b.low_nano <= target) THEN 'TARGET' END AS reason, b.open_nano AS bo
  FROM q JOIN bars b ON b.market = q.market AND b.contract = q.contract AND b.event_at_ns >= q.entry_at AND b.event_at_ns < q.entry_at + {_PATH}),
f AS (SELECT *, CASE reason WHEN 'STOP' THEN stop WHEN 'TARGET' THEN target ELSE bo END - d * t * {_TICK} // 2 AS exit FROM x WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market, contract, entry_at, scenario ORDER BY tm) = 1)
SELECT q.market, q.contract, q.entry_at, q.scenario, q.planned > 1000000 AS over_cap, CASE WHEN q.planned > 1000000 THEN 'OVER_PLANNED_LOSS' ELSE coalesce(f.reason, 'NO_EXIT') END AS reason,
 CASE WHEN q.planned <= 1000000 THEN coalesce(f.tm, -1) ELSE -1 END AS exit_at, CASE WHEN q.planned <= 1000000 THEN coalesce(q.d * (f.exit - q.entry) // {_TICK} * {_TICK_CENTS} - 2 * {_FEE}, 0) ELSE 0 END AS net_cents,
 CASE WHEN q.planned <= 1000000 AND f.exit IS NOT NULL THEN q.d * (f.exit - q.entry) // {_TICK} * {_TICK_CENTS} + q.t * {_TICK_CENTS} ELSE 0 END AS gross_cents
FROM q LEFT JOIN f ON f.market = q.market AND f.contract = q.contract AND f.entry_at = q.entry_at AND f.scenario = q.scenario"""


def _fills(spark: SparkSession, sf_dir: str, net_target: bool, liquidation: bool) -> DataFrame:
    b = tables.bars(spark, sf_dir)
    e = b.where("open_nano > 0").select(
        "market", "contract", F.col("event_at_ns").alias("entry_at"), F.col("open_nano").alias("entry_open"), F.when(clock.floor_div("open_nano", 1000) % 2 == 0, 1).otherwise(-1).alias("direction"), (F.col("high_nano") - F.col("low_nano") + _TICK).alias("atr"))
    last = clock.floor_to("entry_at", D) + 20 * H if liquidation else None
    found = labels.cost_fills(e, b, ["market", "contract"], _COSTS, H, _TICK, _TICK_CENTS, _FEE, 1_000_000, _HOLD, _PATH, last, net_target)
    none = lambda c, v: F.coalesce(c, F.lit(v).cast("long")).alias(c)
    return found.select("market", "contract", "entry_at", "scenario", (F.col("planned_cents") > 1_000_000).alias("over_cap"), "reason", none("exit_at", -1), none("net_cents", 0), none("gross_cents", 0))


@query(_fill_sql(False, True))
def bracket_fill_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-02, Q-10: adverse half spreads on both sides, a target of twice the planned loss, stop before target, liquidation at the session's end."""
    return _fills(spark, sf_dir, False, True)


@query(_fill_sql(True, False))
def bracket_fill_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-03: the same per cost scenario, with a target that is net of them and no session end."""
    return _fills(spark, sf_dir, True, False)


@query(
    f"""WITH {tables.bars_sql()}, e AS (SELECT market, contract, event_at_ns AS tm, open_nano AS entry FROM bars WHERE event_at_ns // {H} % 24 = 13), s AS (SELECT e.*, d, greatest(1, (100000 - 2 * {_FEE} - 4 * {_TICK_CENTS}) // {_TICK_CENTS} // 50) AS ticks FROM e CROSS JOIN (VALUES (1), (-1)) v(d)),
p AS (SELECT s.*, (b.event_at_ns - tm) // {H} AS k, b.open_nano AS o, CASE WHEN d > 0 THEN b.low_nano ELSE b.high_nano END AS worst, entry - d * ticks * {_TICK} AS stop FROM s JOIN bars b ON b.market = s.market AND b.contract = s.contract AND b.event_at_ns BETWEEN tm AND tm + {4 * H}),
x AS (SELECT market, contract, tm, d, count(*) AS n, any_value(entry) AS entry, min(CASE WHEN k < 4 AND ((k > 0 AND d * (o - stop) <= 0) OR d * (worst - stop) <= 0) THEN k END) AS hit, any_value(stop) AS stop, max(CASE WHEN k = 4 THEN o END) AS last FROM p GROUP BY 1, 2, 3, 4),
y AS (SELECT x.*, CASE WHEN hit IS NULL THEN last WHEN hit > 0 AND x.d * (p.o - x.stop) <= 0 THEN p.o ELSE x.stop END AS exit FROM x LEFT JOIN p ON p.market = x.market AND p.contract = x.contract AND p.tm = x.tm AND p.d = x.d AND p.k = x.hit)
SELECT market, contract, tm AS entry_at, d::BIGINT AS direction, n = 5 AS complete, CASE WHEN n = 5 THEN d * (exit - entry) * {_TICK_CENTS} // {_TICK} - {2 * _FEE + 4 * _TICK_CENTS} ELSE 0 END AS net_cents FROM y"""
)
def overnight_reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-16: a complete path of bars, out at the stop (a gap counts from the second bar on) or at the last open, less fixed costs."""
    b = tables.bars(spark, sf_dir)
    e = b.where(clock.floor_div("event_at_ns", H) % 24 == 13).select("market", "contract", F.col("event_at_ns").alias("at"), F.col("open_nano").alias("entry"))
    e = e.withColumn("direction", F.explode(F.array(F.lit(1).cast("long"), F.lit(-1).cast("long"))))
    costs = 2 * _FEE + 4 * _TICK_CENTS
    return labels.stopped_path(e, b, ["market", "contract"], H, 4, max(1, (100_000 - costs) // _TICK_CENTS // 50) * _TICK).select(
        "market", "contract", F.col("at").alias("entry_at"), "direction", "complete", F.when(F.col("complete"), clock.floor_div(F.col("direction") * (F.col("exit") - F.col("entry")) * _TICK_CENTS, _TICK) - costs).otherwise(F.lit(0).cast("long")).alias("net_cents"))


@query(
    f"""WITH {tables.bars_sql()}, c AS (SELECT market, event_at_ns, max(close_nano) AS c FROM bars GROUP BY 1, 2), d AS (SELECT *, c - lag(c) OVER (PARTITION BY market ORDER BY event_at_ns) AS x FROM c)
SELECT market, event_at_ns, CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x > 0 THEN 'UP' WHEN x < 0 THEN 'DOWN' ELSE 'FLAT' END AS previous_delta, coalesce(x, 0) AS delta_nano FROM d"""
)
def previous_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-07: the sign of the last close less the one before."""
    c = tables.bars(spark, sf_dir).groupBy("market", "event_at_ns").agg(F.max("close_nano").alias("c"))
    c = scans.previous(c, ["market"], ["event_at_ns"], {"c": "was"}, 1_000 * clock.HOUR)
    x = F.col("c") - F.col("was")
    sign = F.when(x.isNull(), "UNKNOWN").when(x > 0, "UP").when(x < 0, "DOWN").otherwise("FLAT")
    return c.select("market", "event_at_ns", sign.alias("previous_delta"), F.coalesce(x, F.lit(0).cast("long")).alias("delta_nano"))
