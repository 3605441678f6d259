"""Queries on live feeds: Structured Streaming over the trade tape, in as many batches as there are files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import sets
from ..streaming import candles as live
from ..streaming import feeds, keyed
from . import tables
from .registry import query
from .storage import fresh

H, M = clock.HOUR, clock.MINUTE
_TAPE = "event_id long, market string, instrument_id long, event_at_ns long, price_nano long, size long, generation long"


def _stream(spark: SparkSession, sf_dir: str, files: int = 3) -> DataFrame:
    """The trade tape as a stream of files in the order of time, one file a batch."""
    path = fresh(spark, "tape")
    t = tables.trades(spark, sf_dir).withColumn("generation", F.col("event_id") % 3)
    first, last = t.agg(F.min("event_at_ns"), F.max("event_at_ns")).first()
    part = F.floor((F.col("event_at_ns") - F.lit(first or 0)) * files / F.lit((last or 0) - (first or 0) + 1))
    for i in range(files):  # one after the other, as files come in the order of their times
        t.where(part == i).select(*(c.split()[0] for c in _TAPE.split(", "))).coalesce(1).write.mode("append").parquet(path)
    return live.trades(spark, path, _TAPE, 1)


def _all(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """What the stream gives after its last batch: of each key the newest form."""
    out, state = fresh(spark, "out"), fresh(spark, "state")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in stream.dtypes) + ", batch int"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is given again replaces itself

    stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(schema).parquet(out)
    return sets.upserted(found.limit(0), found, keys, "batch").drop("batch")


@query(f"""WITH {tables.TRADES} SELECT instrument_id, event_at_ns // {H} AS hour_no, count(*) AS n, min(price_nano) AS low_nano, max(price_nano) AS high_nano FROM trades WHERE instrument_id % 50 < 3 AND event_id % 3 = instrument_id % 3 GROUP BY 1, 2""")
def focus_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-03: the trades of the instruments in focus, of their current generation only, by hour."""
    focus = tables.trades(spark, sf_dir).where("instrument_id % 50 < 3").select("instrument_id", (F.col("instrument_id") % 3).alias("generation")).distinct()
    seen = feeds.focused(_stream(spark, sf_dir), focus)
    return _all(spark, seen.groupBy("instrument_id", clock.floor_div("event_at_ns", H).alias("hour_no")).agg(F.count("*").alias("n"), F.min("price_nano").alias("low_nano"), F.max("price_nano").alias("high_nano")), ["instrument_id", "hour_no"])


_T0 = 1704067200 * 10**9


@query(
    f"""WITH {tables.TRADES}, s AS (SELECT i AS instrument_id, 'S' || (i + k) AS symbol, {_T0} + k * {240 * H} AS f, {_T0} + (k + 1) * {240 * H} AS t FROM range(0, 400) a(i), range(0, 2) b(k) WHERE i % 5 <> 4)
SELECT coalesce(symbol, 'UNMAPPED') AS symbol, count(*) AS n, sum(size)::BIGINT AS volume, max(event_at_ns) AS last_ns FROM trades t LEFT JOIN s ON s.instrument_id = t.instrument_id AND t.event_at_ns >= f AND t.event_at_ns < s.t GROUP BY 1"""
)
def overview_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-02: the state of every symbol from one stream, instruments mapped by the interval that holds; what isn't mapped is counted."""
    i = F.col("id")
    s = spark.range(400).where("id % 5 <> 4").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>"))).select(
        i.alias("instrument_id"), F.concat(F.lit("S"), i + F.col("k")).alias("symbol"), (F.col("k") * (240 * H) + _T0).alias("from_ns"), ((F.col("k") + 1) * (240 * H) + _T0).alias("to_ns"))
    seen = feeds.mapped(_stream(spark, sf_dir), s)
    return _all(spark, seen.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.max("event_at_ns").alias("last_ns")), ["symbol"])


@query(f"""WITH {tables.TRADES} SELECT market, event_at_ns // {15 * M} AS slot, arg_max(price_nano, (event_at_ns, event_id)) AS price_nano, count(*) AS updates FROM trades GROUP BY 1, 2""")
def throttled_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-08: at most one update of a market in each interval, the last."""
    return _all(spark, feeds.throttled(_stream(spark, sf_dir), ["market"], "event_at_ns", ["event_id"], 15 * M, ["price_nano"]), ["market", "slot"])


@query(
    f"""WITH {tables.TRADES}, g AS (SELECT *, CASE WHEN event_at_ns - lag(event_at_ns) OVER w > {40 * M} THEN 1 ELSE 0 END AS gap FROM trades WINDOW w AS (PARTITION BY market ORDER BY event_at_ns, event_id)),
r AS (SELECT *, sum(gap) OVER (PARTITION BY market ORDER BY event_at_ns, event_id) AS run FROM g), i AS (SELECT *, row_number() OVER (PARTITION BY market, run ORDER BY event_at_ns, event_id) AS i FROM r)
SELECT market, min(event_id) AS first_id, count(*) AS n FROM i GROUP BY market, run, (i - 1) // 4"""
)
def drained_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-09: batches that end after four records or forty idle minutes."""
    d = feeds.drained(tables.trades(spark, sf_dir).select("market", "event_at_ns", "event_id"), ["market"], "event_at_ns", ["event_id"], 4, 40 * M)
    return d.groupBy("market", "batch").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).select("market", "first_id", "n")


def _streamed(spark: SparkSession, rows: DataFrame, order: str, schema: str, files: int = 3, last: DataFrame | None = None) -> DataFrame:
    """``rows`` as a stream of files, dealt by equal parts of ``order`` and one a batch; ``last`` is a file after them."""
    path = fresh(spark, "records")
    names = [c.split()[0] for c in schema.split(", ")]
    first, end = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - F.lit(first or 0)) * files / F.lit((end or 0) - (first or 0) + 1))
    for i in range(files):
        rows.where(part == i).select(*names).coalesce(1).write.parquet(f"{path}/part={i}")  # a batch ends where a part does, as order matters
    if last is not None:
        last.select(*names).coalesce(1).write.parquet(f"{path}/part={files}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def _heartbeat(spark: SparkSession, days: int = 400) -> DataFrame:
    """A record of no market long after all others: it moves the watermark, so that what is still held is given out."""
    return spark.range(1).select(F.lit("~").alias("market"), F.lit(_T0 + days * clock.DAY).alias("at_ns"), F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("price_nano"))


def _run(spark: SparkSession, stream: DataFrame, schema: str) -> DataFrame:
    return keyed.run(stream, fresh(spark, "out"), fresh(spark, "state"), schema)


@query(
    f"""WITH {tables.TRADES}, s AS (SELECT i AS instrument_id, 'S' || (i + k) AS market, 'S' || (i + k) || 'C' || k AS contract, {_T0} + k * {240 * H} AS f FROM range(0, 400) a(i), range(0, 2) b(k) WHERE i % 5 <> 4),
m AS (SELECT t.event_id, s.market, s.contract, t.event_at_ns, t.value FROM trades t ASOF JOIN s ON s.instrument_id = t.instrument_id AND t.event_at_ns >= s.f)
SELECT event_id, market, contract, value AS "last", round((value / nullif(lag(value) OVER (PARTITION BY market ORDER BY event_at_ns, event_id), 0) - 1) * 100, 6) AS change FROM m"""
)
def overview_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-02: mapping records and bars in one stream: the last mapping of an instrument names its market, whose state gives the change from its bar before, over rolls, too."""
    i, k = F.col("id"), F.col("k")
    maps = spark.range(400).where("id % 5 <> 4").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>"))).select(
        i.alias("instrument_id"), (k * (240 * H) + _T0).alias("at_ns"), F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("S"), i + k).alias("symbol"), F.concat(F.lit("S"), i + k, F.lit("C"), k).alias("contract"), F.lit(None).cast("double").alias("close"))
    none = F.lit(None).cast("string")
    bars = tables.trades(spark, sf_dir).select("instrument_id", F.col("event_at_ns").alias("at_ns"), F.col("event_id").alias("seq"), none.alias("symbol"), none.alias("contract"), F.col("value").alias("close"))
    stream = _streamed(spark, maps.union(bars), "at_ns", "instrument_id long, at_ns long, seq long, symbol string, contract string, close double")
    found = _run(spark, keyed.overview(stream), keyed.Status.OUT)
    return found.select(F.col("seq").alias("event_id"), "market", "contract", "last", F.round("change", 6).alias("change"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.trades(spark, sf_dir).select("market", F.col("event_at_ns").alias("at_ns"), F.col("event_id").alias("seq"), "price_nano")
    return _streamed(spark, t, "at_ns", "market string, at_ns long, seq long, price_nano long", last=_heartbeat(spark))


@query(
    f"""WITH {tables.TRADES}, g AS (SELECT *, CASE WHEN event_at_ns - lag(event_at_ns) OVER w > {40 * M} THEN 1 ELSE 0 END AS gap FROM trades WINDOW w AS (PARTITION BY market ORDER BY event_at_ns, event_id)),
r AS (SELECT *, sum(gap) OVER (PARTITION BY market ORDER BY event_at_ns, event_id) AS run FROM g), i AS (SELECT *, row_number() OVER (PARTITION BY market, run ORDER BY event_at_ns, event_id) - 1 AS i FROM r),
b AS (SELECT *, count(*) OVER (PARTITION BY market, run, i // 4) AS n, dense_rank() OVER (PARTITION BY market ORDER BY run, i // 4) - 1 AS batch FROM i)
SELECT market, batch, event_id AS seq, (i % 4)::INTEGER AS place, CASE WHEN n = 4 THEN 'FULL' ELSE 'IDLE' END AS closed FROM b"""
)
def drained_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-09: records held in state until four are there or a timer of forty idle minutes ends the batch; each is given out once."""
    return _run(spark, keyed.drained(_updates(spark, sf_dir), 4, 40 * M), keyed.Drain.OUT)


@query(f"""WITH {tables.TRADES} SELECT market, event_at_ns // {15 * M} AS slot, arg_max(price_nano, (event_at_ns, event_id)) AS price_nano, count(*) AS updates FROM trades GROUP BY 1, 2""")
def throttled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-08: the last update of an interval, given out once, when a later interval begins or the interval's timer fires."""
    return _run(spark, keyed.throttled(_updates(spark, sf_dir), 15 * M), keyed.Throttle.OUT).where("market <> '~'")


@query(
    f"""WITH {tables.TRADES}, l AS (SELECT market, event_at_ns AS tm, lag(event_at_ns) OVER w AS was, lead(event_at_ns) OVER w AS nxt FROM trades WINDOW w AS (PARTITION BY market ORDER BY event_at_ns, event_id))
SELECT market, 'LIVE' AS state, tm AS at_ns, tm AS last_ns FROM l WHERE was IS NULL OR tm - was > {2 * H} UNION ALL SELECT market, 'STALE', tm + {2 * H}, tm FROM l WHERE nxt IS NULL OR nxt - tm > {2 * H}"""
)
def stale_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-04: markets go stale by a timer when no bar has come for two hours, and live again with the next one; each change is told once."""
    return _run(spark, keyed.staleness(_updates(spark, sf_dir), 2 * H), keyed.Stale.OUT).where("market <> '~'")


@query(
    f"""WITH {tables.TRADES}, s AS (SELECT market, event_at_ns // {24 * H} AS session, arg_min(price_nano, (event_at_ns, event_id)) AS first_nano, arg_max(price_nano, (event_at_ns, event_id)) AS last_nano, count(*) AS bars FROM trades GROUP BY 1, 2)
SELECT market, session, first_nano, last_nano, bars, coalesce(lag(CASE WHEN last_nano > first_nano THEN 'UP' WHEN last_nano < first_nano THEN 'DOWN' ELSE 'FLAT' END) OVER (PARTITION BY market ORDER BY session), 'NONE') AS previous FROM s"""
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-10, M-11: one observation a session from a stream in order, with one session in state and the direction of the one before; a session that goes back is an error."""
    t = tables.trades(spark, sf_dir).select("market", F.col("event_at_ns").alias("at_ns"), F.col("event_id").alias("seq"), clock.floor_div("event_at_ns", 24 * H).alias("session"), "price_nano")
    stream = _streamed(spark, t, "at_ns", "market string, at_ns long, seq long, session long, price_nano long", last=_heartbeat(spark).withColumn("session", F.lit(10**9).cast("long")))
    return _run(spark, keyed.sessions(stream, 24 * H), keyed.Sessions.OUT).where("market <> '~'")


_MID, _END = _T0 // H + 360, _T0 // H + 24 * 400


@query(
    f"""WITH {tables.TRADES}, b AS (SELECT instrument_id % 60 AS instrument, event_at_ns // {H} AS k, event_id % 2 = 1 AS live, sum(price_nano)::BIGINT AS v FROM trades GROUP BY 1, 2, 3),
l AS (SELECT instrument, k, max(v) FILTER (live) AS a, max(v) FILTER (NOT live) + CASE WHEN k < {_MID} THEN 0 ELSE 7 END AS b FROM b GROUP BY 1, 2)
SELECT instrument, k AS hour_no, coalesce(b, a) AS v, CASE WHEN b IS NULL THEN 'LIVE' ELSE 'HISTORY' END AS source, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS changes FROM l"""
)
def merged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-05, M-06, M-07: live bars and replayed history in one stream; history replaces a live bar once, repeats change nothing, and what comes for times before an instrument's watermark is too late."""
    t = tables.trades(spark, sf_dir)
    b = t.groupBy((F.col("instrument_id") % 60).alias("instrument"), clock.floor_div("event_at_ns", H).alias("k"), (F.col("event_id") % 2 == 1).alias("live")).agg(F.sum("price_nano").alias("value"))
    wide = F.lit(1_000_000)
    row = lambda kind, at, value, until, seq: [F.lit(kind).alias("kind"), at.alias("at_ns"), value.alias("value"), F.lit(until * H).alias("until_ns"), seq.cast("long").alias("seq")]
    k = F.col("k")
    live = b.where("live").select("instrument", *row("LIVE", k * H, F.col("value"), 0, k - _T0 // H))
    past = b.where("not live")
    early = past.where(k < _MID)
    history = early.select("instrument", *row("HISTORY", k * H, F.col("value"), _MID, wide + k))
    beyond = past.where(k >= _MID).select("instrument", *row("HISTORY", k * H, F.col("value") - 1, _MID, wide + k))  # after its chunk's end: not complete yet
    done = b.select("instrument").distinct().select("instrument", *row("COMPLETED", F.lit(0).cast("long"), F.lit(0).cast("long"), _MID, wide * 2))
    late = early.select("instrument", *row("HISTORY", k * H, F.col("value") + 5, _END, wide * 3 + k))
    newer = past.where(k >= _MID).select("instrument", *row("HISTORY", k * H, F.col("value") + 7, _END, wide * 3 + k))
    again = newer.withColumn("seq", F.col("seq") + wide)
    records = [live, history, history.withColumn("seq", F.col("seq") + 1), beyond, done, late, newer, again]
    every = records[0]
    for r in records[1:]:
        every = every.unionByName(r)
    stream = _streamed(spark, every, "seq", "instrument long, seq long, kind string, at_ns long, value long, until_ns long", 4)
    found = _run(spark, keyed.merged(stream), keyed.Merge.OUT)
    newest = F.max_by(F.struct("value", "source"), "seq").alias("_new")
    return found.groupBy("instrument", clock.floor_div("at_ns", H).alias("hour_no")).agg(newest, F.count("*").cast("int").alias("changes")).select("instrument", "hour_no", F.col("_new.value").alias("v"), F.col("_new.source").alias("source"), "changes")


@query(
    f"""WITH {tables.TRADES}, l AS (SELECT market, event_id, max(price_nano) OVER w20 - min(price_nano) OVER w20 AS range_nano, lead(price_nano, 60) OVER w - price_nano AS label_nano, row_number() OVER w AS i, count(*) OVER (PARTITION BY market) AS n FROM trades
  WINDOW w AS (PARTITION BY market ORDER BY event_id), w20 AS (PARTITION BY market ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) SELECT market, event_id, range_nano, label_nano FROM l WHERE i > 20 AND i <= n - 60"""
)
def carried_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-12: labels over twenty rows before and sixty after, from a stream whose batches end anywhere."""
    stream = _stream(spark, sf_dir).select("market", "event_id", "price_nano")
    path, state = fresh(spark, "carried"), fresh(spark, "state")

    def label(w: WindowSpec) -> list[Column]:
        near = w.rowsBetween(-20, 0)
        return [(F.max("price_nano").over(near) - F.min("price_nano").over(near)).alias("range_nano"), (F.lead("price_nano", 60).over(w) - F.col("price_nano")).alias("label_nano")]

    live.run_once(stream, state, feeds.carried(path, ["market"], "event_id", 20, 60, label))
    return spark.read.parquet(f"{path}/labels").select("market", "event_id", "range_nano", "label_nano")


def decoded(rows: DataFrame, decode_one: Callable[[bytes], tuple], body: str, schema: str) -> DataFrame:
    """``rows`` with the fields that ``decode_one`` makes of each body, batch by batch; what it refuses has null fields."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.drop(body).dtypes)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pdf.drop(columns=[body]).reset_index(drop=True)
            made = []
            for b in pdf[body]:
                try:
                    made.append(decode_one(b))
                except ValueError:
                    made.append((None,) * len(names))
            yield pd.concat([out, pd.DataFrame(made, columns=names)], axis=1)

    return rows.mapInPandas(work, f"{kinds}, {schema}")


def _decode_status(body: bytes) -> tuple:
    kind, at, action = body.decode().split("|")
    if kind != "S":
        raise ValueError(kind)
    return int(at), action


@query("""SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN user_id ELSE -1 END AS received, CASE WHEN event_id % 13 <> 0 THEN event_type ELSE '' END AS action FROM events""")
def injected_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-02, N-01: a decoder that the caller gives, run in batches; a record of another kind is kept without fields."""
    e = tables.table(spark, sf_dir, "events")
    body = F.concat_ws("|", F.when(F.col("event_id") % 13 == 0, "X").otherwise("S"), F.col("user_id").cast("string"), "event_type").cast("binary")
    found = decoded(e.select("event_id", body.alias("body")), _decode_status, "body", "received long, action string")
    return found.select("event_id", F.coalesce("received", F.lit(-1).cast("long")).alias("received"), F.coalesce("action", F.lit("")).alias("action"))


Source = Callable[[DataFrame], DataFrame]


def null_predictions(asked: DataFrame) -> DataFrame:
    """A source of predictions that has none: every opportunity abstains."""
    return asked.select("*", F.lit(None).cast("double").alias("prediction"), F.lit("ABSTAIN_NO_SOURCE").alias("state"))


def synthetic_predictions(asked: DataFrame) -> DataFrame:
    """A source that makes predictions up from the opportunity's number."""
    return asked.select("*", ((F.col("event_id") % 200 - 100) / 100).alias("prediction"), F.lit("SYNTHETIC").alias("state"))


def known_definitions(asked: DataFrame) -> DataFrame:
    """A source of definitions: an instrument's symbol, unresolved for every ninth."""
    i = F.col("instrument_id")
    return asked.withColumn("symbol", F.when(i % 9 != 0, F.concat(F.lit("C"), i)))


def observed(rows: DataFrame, definitions: Source, predictions: Source) -> DataFrame:
    """Opportunities with what the given sources say of them; an unresolved definition leaves no prediction."""
    found = predictions(definitions(rows))
    resolved = F.col("symbol").isNotNull()
    return found.withColumns({"prediction": F.when(resolved, F.col("prediction")), "state": F.when(resolved, F.col("state")).otherwise("UNRESOLVED_DEFINITION")})


@query(
    """WITH e AS (SELECT event_id, user_id % 9 <> 0 AS ok FROM events) SELECT source, state, count(*) AS n, round(coalesce(sum(p), 0), 4) AS total FROM (
SELECT 'null' AS source, CASE WHEN ok THEN 'ABSTAIN_NO_SOURCE' ELSE 'UNRESOLVED_DEFINITION' END AS state, NULL::DOUBLE AS p FROM e UNION ALL SELECT 'synthetic', CASE WHEN ok THEN 'SYNTHETIC' ELSE 'UNRESOLVED_DEFINITION' END, CASE WHEN ok THEN (event_id % 200 - 100) / 100 END FROM e) GROUP BY 1, 2"""
)
def injected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-04, N-05: definitions and predictions come from sources that the caller gives, null and synthetic ones among them."""
    rows = tables.trades(spark, sf_dir).select("event_id", "instrument_id")
    made = [observed(rows, known_definitions, f).withColumn("source", F.lit(n)) for n, f in (("null", null_predictions), ("synthetic", synthetic_predictions))]
    both = made[0].unionByName(made[1])
    return both.groupBy("source", "state").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("prediction"), F.lit(0.0)), 4).alias("total"))

