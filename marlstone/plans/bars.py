"""Queries on trades and bars: aggregation, validity, coverage, gaps, order, censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, codes, prices
from ..operators import bars as ops
from ..operators import scans
from . import tables
from .registry import query

H = clock.HOUR
W = f"WITH {tables.bars_sql()}"
_OHLC = "open_nano, high_nano, low_nano, close_nano, volume"
_AGG = "arg_min(price_nano, ts) AS open_nano, max(price_nano) AS high_nano, min(price_nano) AS low_nano, arg_max(price_nano, ts) AS close_nano, sum(size)::BIGINT AS volume"


@query(
    """SELECT event_type AS market, time_bucket(INTERVAL '1 hour', ts) AS bucket, arg_min(value, ts) AS open,
max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY ALL"""
)
def ohlcv_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01: candles of one hour."""
    e = tables.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("market"), F.date_trunc("hour", "ts").alias("bucket")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))


@query(f"WITH {tables.TRADES} SELECT market, time_bucket(INTERVAL '5 minutes', ts) AS bucket, {_AGG} FROM trades GROUP BY 1, 2")
def candles_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-02, I-05."""
    return ops.candles(tables.trades(spark, sf_dir), ["market"], "ts", "price_nano", "size", "5m", "event_id")


@query(
    f"""WITH {tables.TRADES}, l AS (SELECT *, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') AS here FROM trades)
SELECT market, ((date_trunc('day', here) + to_hours((hour(here) // 4 * 4)::BIGINT)) AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC') AS bucket, {_AGG} FROM l GROUP BY 1, 2"""
)
def candles_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-02, I-06: four-hour candles by the exchange's wall clock."""
    return ops.candles(tables.trades(spark, sf_dir), ["market"], "ts", "price_nano", "size", "4h", "event_id")


@query(
    f"""WITH {tables.TRADES}, l AS (SELECT *, CAST((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') + INTERVAL 7 HOUR AS DATE) AS day FROM trades)
SELECT market, ((day - 1)::TIMESTAMP + INTERVAL 17 HOUR) AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC' AS bucket, {_AGG} FROM l GROUP BY 1, 2"""
)
def candles_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-02, I-04, I-07: daily candles of the exchange session."""
    return ops.candles(tables.trades(spark, sf_dir), ["market"], "ts", "price_nano", "size", "1d", "event_id")


@query(f"""{W} SELECT market, event_at_ns // {4 * H} * {4 * H} AS bucket_ns, arg_min(open_nano, event_at_ns) AS open_nano, max(high_nano) AS high_nano, min(low_nano) AS low_nano,
arg_max(close_nano, event_at_ns) AS close_nano, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1, 2""")
def bars_reaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01: bars from bars."""
    return ops.reaggregated(tables.bars(spark, sf_dir), ["market"], 4 * H)


@query(
    f"""{W} SELECT market, CASE WHEN NOT (least(open_nano, high_nano, low_nano, close_nano) > 0 AND high_nano >= greatest(open_nano, close_nano) AND low_nano <= least(open_nano, close_nano) AND volume >= 0) THEN 'INVALID_PRICES'
WHEN volume < 2 THEN 'THIN' ELSE 'ELIGIBLE' END AS disposition, count(*) AS n, min(event_at_ns) AS first_ns, max(event_at_ns) AS last_ns FROM bars GROUP BY 1, 2"""
)
def disposition_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-02, C-12, E-03, E-04, E-07: every bar keeps its row and gets a disposition."""
    return ops.census(tables.bars(spark, sf_dir).withColumn("disposition", ops.disposition(2)), ["market"], "disposition")


@query(
    f"""{W}, f AS (SELECT *, open_nano > 0 AND high_nano >= low_nano AND volume >= 2 AS ok FROM bars) SELECT market, contract, event_at_ns,
CASE WHEN ok THEN round((close_nano - open_nano) / open_nano, 9) END AS bar_body_fraction, CASE WHEN ok THEN round(close_nano / open_nano - 1, 9) END AS bar_return, CASE WHEN ok THEN round((high_nano - low_nano) / open_nano, 9) END AS intrabar_range_fraction FROM f"""
)
def bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-01, C-14."""
    f = tables.bars(spark, sf_dir).select("market", "contract", "event_at_ns", *ops.features(F.col("volume") >= 2))
    return f.select("market", "contract", "event_at_ns", *(F.round(c, 9).alias(c) for c in f.columns[3:]))


@query(f"""{W} SELECT market, event_at_ns, (greatest(available_at_ns, event_at_ns) + 59999999999) // 60000000000 * 60000000000 AS decision_at_ns FROM bars""")
def decision_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-03, C-04."""
    return tables.bars(spark, sf_dir).select("market", "event_at_ns", clock.decision_at("available_at_ns", "event_at_ns").alias("decision_at_ns"))


@query(
    f"""{W}, i AS (SELECT market, event_at_ns AS s, event_at_ns + {H} AS e FROM bars), r AS (SELECT *, max(e) OVER (PARTITION BY market ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY market ORDER BY s, e) AS island FROM r)
SELECT market, min(s) AS start_ns, max(e) AS end_ns, count(*) AS parts FROM k GROUP BY market, island"""
)
def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-16: covered time as merged intervals."""
    i = tables.bars(spark, sf_dir).select("market", F.col("event_at_ns").alias("start_ns"), (F.col("event_at_ns") + H).alias("end_ns"))
    return ops.islands(i, ["market"], "start_ns", "end_ns")


_DAY0 = 1704067200 * 10**9


@query(
    f"""{W}, d AS (SELECT DISTINCT market, event_at_ns FROM bars), g AS (SELECT market, unnest(generate_series({_DAY0}::BIGINT, {_DAY0 + 29 * clock.DAY - H}::BIGINT, {H})) AS h FROM (SELECT DISTINCT market FROM d)),
m AS (SELECT g.market, h FROM g ANTI JOIN d ON d.market = g.market AND d.event_at_ns = g.h), n AS (SELECT *, h - {H} * row_number() OVER (PARTITION BY market ORDER BY h) AS k FROM m)
SELECT market, min(h) AS gap_start, max(h) + {H} AS gap_end FROM n GROUP BY market, k"""
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-12, M-05: the complement of the coverage in a window."""
    i = tables.bars(spark, sf_dir).select("market", F.col("event_at_ns").alias("start_ns"), (F.col("event_at_ns") + H).alias("end_ns"))
    return ops.gaps(ops.islands(i, ["market"], "start_ns", "end_ns"), ["market"], "start_ns", "end_ns", _DAY0, _DAY0 + 29 * clock.DAY)


@query(
    f"""{W}, d AS (SELECT DISTINCT market, event_at_ns FROM bars), g AS (SELECT market, unnest(generate_series(min(event_at_ns), max(event_at_ns), {H})) AS event_at_ns FROM d GROUP BY market)
SELECT g.market, g.event_at_ns FROM g ANTI JOIN d ON g.market = d.market AND g.event_at_ns = d.event_at_ns"""
)
def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11, F-12, O-05."""
    return ops.missing_steps(tables.bars(spark, sf_dir), ["market"], H)


@query(f"""{W}, l AS (SELECT market, event_at_ns, lag(event_at_ns) OVER (PARTITION BY market ORDER BY event_at_ns, contract) AS was FROM bars)
SELECT market, event_at_ns, event_at_ns - was AS step_ns FROM l WHERE event_at_ns - was <> {H}""")
def contiguity_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-09, F-10."""
    b = scans.previous(tables.bars(spark, sf_dir), ["market"], ["event_at_ns", "contract"], {"event_at_ns": "was"}, 1_000 * H)
    b = b.withColumn("step_ns", F.col("event_at_ns") - F.col("was"))
    return b.where(f"step_ns <> {H}").select("market", "event_at_ns", "step_ns")


@query(f"""WITH {tables.TRADES}, l AS (SELECT market, event_id, event_at_ns, instrument_id, lag(instrument_id) OVER (PARTITION BY market ORDER BY event_id) AS was FROM trades) SELECT market, event_id FROM l WHERE was >= instrument_id""")
def order_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11, F-13: rows that don't come strictly after the one before, here by instrument in file order."""
    t = scans.previous(tables.trades(spark, sf_dir).select("market", "event_id", "instrument_id"), ["market"], ["event_id"], {"instrument_id": "was"})
    return t.where("was >= instrument_id").select("market", "event_id")


@query(
    """SELECT event_id, epoch_us(ts) * 1000 AS ns, CAST(ts AS DATE)::VARCHAR AS day, CAST((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') + INTERVAL 7 HOUR AS DATE)::VARCHAR AS session,
(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') * 60 + minute(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') - 1020 + 1440) % 1440 AS minute_no,
strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago', '%H:%M:%S') BETWEEN '08:30:00' AND '15:00:00' AS in_clock FROM events"""
)
def clock_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-02, I-03, I-04, I-12, C-15."""
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", clock.ns("ts").alias("ns"), clock.utc_date(clock.ns("ts")).cast("string").alias("day"), clock.session_date("ts").cast("string").alias("session"), clock.minute_of_session("ts").cast("long").alias("minute_no"), clock.in_local_clock("ts", "08:30:00", "15:00:00").alias("in_clock"))


@query("""SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-18: sorted keys, no spaces."""
    return tables.table(spark, sf_dir, "nation").select("n_nationkey", codes.canonical_json("n_nationkey", "n_name", "n_regionkey").alias("json"))


@query("""SELECT event_id, sha256(event_id::VARCHAR || '|' || event_type || '|' || user_id::VARCHAR) AS row_sha256, ('0x' || substr(sha256(event_type || ':' || event_id::VARCHAR), 1, 8))::BIGINT AS seed FROM events""")
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-20, O-13, A-12: row hashes."""
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", codes.row_hash("event_id", "event_type", "user_id").alias("row_sha256"), codes.seed("event_type", "event_id").alias("seed"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' ELSE 'UNKNOWN_' || o_orderstatus END AS state,
CASE WHEN o_orderpriority LIKE '1%' THEN 'YES' WHEN o_orderpriority LIKE '2%' THEN 'NO' ELSE 'NOT_AVAILABLE' END AS urgent FROM orders""")
def enum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-22, I-23, A-13, A-14."""
    o = tables.table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderpriority").startswith("1"), "Y").when(F.col("o_orderpriority").startswith("2"), "N").otherwise("~")
    return o.select("o_orderkey", codes.named("o_orderstatus", {"F": "FILLED", "O": "OPEN"}).alias("state"), codes.tri_state(code).alias("urgent"))


_TICK = 250_000_000


@query(
    f"""WITH {tables.TRADES} SELECT event_id, price_nano // {_TICK} * {_TICK} AS floor_nano, (price_nano + {_TICK - 1}) // {_TICK} * {_TICK} AS ceil_nano, price_nano % {_TICK} = 0 AS on_tick, price_nano::DOUBLE / 1e9 AS price,
(price_nano // {_TICK} - 40) * 1250 AS gross_cents, greatest(value * 1.5, 2.0) + value * 2.0 AS cost, (price_nano // {_TICK} + 2) * 1250 + 500 AS planned_loss FROM trades WHERE price_nano >= 0"""
)
def tick_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-01, I-11, I-13, I-14, I-15, I-16, I-17."""
    t = tables.trades(spark, sf_dir).where("price_nano >= 0")
    return t.select(
        "event_id", prices.tick_floor("price_nano", _TICK).alias("floor_nano"), prices.tick_ceil("price_nano", _TICK).alias("ceil_nano"), prices.tick_valid("price_nano", _TICK).alias("on_tick"), prices.as_float("price_nano").alias("price"),
        prices.gross_pnl(F.lit(1), F.lit(40 * _TICK).cast("long"), "price_nano", _TICK, 1250).alias("gross_cents"), prices.scenario_cost("value", "value", 2.0, 1.5, 2.0).alias("cost"), prices.planned_loss(prices.ticks("price_nano", _TICK), 2, 1250, 250).alias("planned_loss"))


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE (l_discount - l_tax) / (abs(l_discount) + abs(l_tax)) END, 9) AS score,
CASE WHEN l_discount - l_tax >= 0.03 THEN 'LONG' WHEN l_discount - l_tax <= -0.03 THEN 'SHORT' ELSE 'NEUTRAL' END AS side, round(1 / (1 + exp(-greatest(-40, least(40, l_quantity - 25)))), 9) AS chance,
CASE WHEN l_discount >= 0.09 OR l_tax >= 0.08 THEN 'PAUSE' WHEN l_discount >= 0.05 OR l_tax >= 0.06 THEN 'WARN' ELSE 'CLEAR' END AS gate FROM lineitem"""
)
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-27, I-28, I-29, I-31."""
    i = tables.table(spark, sf_dir, "lineitem")
    return i.select(
        "l_orderkey", "l_linenumber", F.round(codes.bounded_score("l_discount", "l_tax"), 9).alias("score"), codes.direction(F.col("l_discount") - F.col("l_tax"), 0.03).alias("side"),
        F.round(codes.sigmoid(F.col("l_quantity") - 25), 9).alias("chance"), codes.gate("l_discount", "l_tax", (0.05, 0.06), (0.09, 0.08)).alias("gate"))


@query("""WITH t AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') / count(*) AS a, count(*) FILTER (o_orderstatus = 'O') / count(*) AS b, count(*) FILTER (o_orderstatus = 'P') / count(*) AS c FROM orders GROUP BY 1)
SELECT o_custkey, round((CASE WHEN a > 0 THEN -a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN -b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN -c * ln(c) ELSE 0 END) / ln(3), 9) AS entropy FROM t""")
def direction_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-30."""
    o = tables.table(spark, sf_dir, "orders")
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("double"))
    t = o.groupBy("o_custkey").agg(share("F").alias("a"), share("O").alias("b"), share("P").alias("c"))
    return t.select("o_custkey", F.round(codes.entropy3("a", "b", "c"), 9).alias("entropy"))


@query(
    """WITH r AS (SELECT c_custkey, list_sort(list_filter([CASE WHEN NOT c_acctbal >= 0 THEN 'NEGATIVE_BALANCE' END, CASE WHEN NOT c_nationkey < 20 THEN 'FOREIGN' END, CASE WHEN NOT c_mktsegment <> 'MACHINERY' THEN 'SEGMENT' END], lambda x: x IS NOT NULL)) AS codes FROM customer)
SELECT c_custkey, array_to_string(codes, ',') AS reasons, CASE WHEN len(codes) = 0 THEN 'READY' ELSE 'ABSTAIN' END AS state FROM r"""
)
def abstention_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-18, J-14, K-27, L-13: every failed check is listed."""
    c = tables.table(spark, sf_dir, "customer")
    found = codes.reasons((F.col("c_acctbal") >= 0, "NEGATIVE_BALANCE"), (F.col("c_nationkey") < 20, "FOREIGN"), (F.col("c_mktsegment") != "MACHINERY", "SEGMENT"))
    return c.select("c_custkey", F.array_join(found, ",").alias("reasons"), F.when(F.size(found) == 0, "READY").otherwise("ABSTAIN").alias("state"))


@query(f"""WITH {tables.TRADES} SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'EPOCH_A' ELSE 'EPOCH_B' END AS epoch, CASE WHEN day(ts) <= 15 THEN 'DISCOVERY' WHEN day(ts) <= 24 THEN 'HOLDOUT' ELSE 'FORWARD' END AS cohort,
(market = 'error' AND day(ts) IN (3, 4)) AS quarantined, price_nano <= 10000000000 + 2500000000 OR price_nano >= 90000000000 - 2500000000 AS near_limit FROM trades""")
def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-17: classifications."""
    t = tables.trades(spark, sf_dir)
    day = F.dayofmonth("ts")
    near = prices.near_limit("price_nano", F.lit(10 * prices.NANO), F.lit(90 * prices.NANO), F.lit(50 * prices.NANO), 0.05)
    return t.select(
        "event_id", F.when(F.col("ts") < F.lit("2024-01-10").cast("timestamp"), "EPOCH_A").otherwise("EPOCH_B").alias("epoch"), F.when(day <= 15, "DISCOVERY").when(day <= 24, "HOLDOUT").otherwise("FORWARD").alias("cohort"),
        ((F.col("market") == "error") & day.isin(3, 4)).alias("quarantined"), near.alias("near_limit"))


@query("""SELECT page_id, lower(regexp_extract(url, '^(?:[hH][tT][tT][pP][sS]?)://([^/?#:]+)', 1)) AS host, len(regexp_extract_all(html, '<a [^>]*href="[^"]*"'))::BIGINT AS links FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-31: hosts and anchors of stored pages."""
    p = tables.table(spark, sf_dir, "pages")
    return p.select("page_id", codes.url_host("url").alias("host"), F.regexp_count("html", F.lit('<a [^>]*href="[^"]*"')).cast("long").alias("links"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24: JSON text to columns, with a schema."""
    return tables.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@query(
    f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY event_at_ns DESC, contract) AS n FROM bars) SELECT market, event_at_ns, n::INTEGER AS n FROM r WHERE n <= 21"""
)
def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-02, G-10: the newest rows of each key."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("market").orderBy(F.desc("event_at_ns"), "contract"))
    return tables.bars(spark, sf_dir).select("market", "event_at_ns", n.alias("n")).where("n <= 21")


@query(f"""WITH {tables.TRADES}, d AS (SELECT DISTINCT market, contract, event_at_ns // {clock.DAY} AS day FROM trades), f AS (SELECT market, contract, min(day) AS a, max(day) AS b FROM d GROUP BY 1, 2),
l AS (SELECT *, lag(contract) OVER (PARTITION BY market ORDER BY a) AS was FROM f) SELECT market, contract, a AS first_day, b AS last_day, was AS rolled_from FROM l""")
def roll_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-25: contracts of each market in order, with what each rolled from."""
    from pyspark.sql import Window

    t = tables.trades(spark, sf_dir).select("market", "contract", clock.floor_div("event_at_ns", clock.DAY).alias("day"))
    spans = t.groupBy("market", "contract").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return spans.withColumn("rolled_from", F.lag("contract").over(Window.partitionBy("market").orderBy("first_day")))


@query(f"""WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day), m AS (SELECT DISTINCT event_type AS market FROM events)
SELECT market, day::VARCHAR AS day, CASE WHEN market = 'view' AND day = DATE '2024-01-13' THEN 'OVERRIDE_OPEN' WHEN dayofweek(day) IN (0, 6) THEN 'CLOSED_WEEKEND' WHEN day = DATE '2024-01-01' THEN 'CLOSED_HOLIDAY' WHEN day = DATE '2024-01-15' THEN 'EARLY_CLOSE' ELSE 'REGULAR' END AS state FROM d, m""")
def rule_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-30, D-26: a calendar from rules, by precedence, for every market and date."""
    markets = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("market")).distinct()
    day = F.col("day")
    state = F.when((F.col("market") == "view") & (day == "2024-01-13"), "OVERRIDE_OPEN").when(F.dayofweek(day).isin(1, 7), "CLOSED_WEEKEND").when(day == "2024-01-01", "CLOSED_HOLIDAY").when(day == "2024-01-15", "EARLY_CLOSE").otherwise("REGULAR")
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")))
    return markets.select("market", days.alias("day")).select("market", day.cast("string").alias("day"), state.alias("state"))


@query(f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), m AS (SELECT (day::TIMESTAMP + INTERVAL 510 MINUTE) AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC' AS opening, 'RTH' AS marker FROM d UNION ALL SELECT (day::TIMESTAMP + INTERVAL 17 HOUR) AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC', 'GLOBEX' FROM d)
SELECT DISTINCT marker, time_bucket(INTERVAL '1 hour', opening) AS bucket FROM m""")
def session_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-14: opening times of the sessions, put into candles."""
    days = tables.table(spark, sf_dir, "events").select(F.to_date("ts").cast("timestamp").alias("day")).distinct()
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("marker"), F.lit(m).alias("minute")) for n, m in (("RTH", 510), ("GLOBEX", 1020)))))
    at = F.to_utc_timestamp(F.col("day") + F.make_dt_interval(mins=F.col("m.minute")), clock.EXCHANGE_ZONE)
    return days.select("day", both.alias("m")).select("m.marker", F.date_trunc("hour", at).alias("bucket")).distinct()
