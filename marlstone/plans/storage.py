"""Queries that write and read again: sinks, releases, catalogs, merges and streams, in the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import clock
from ..operators import bars as bar_ops
from ..operators import ridge, sets
from ..sources import readers, sinks
from ..sources.scratch import fresh
from ..streaming import candles as live
from . import tables
from .registry import query
from .research import _solved

H = clock.HOUR

#: What a stored bar file holds; the market is the folder it stands in.
BAR_FILE = StructType([StructField("event_at_ns", LongType()), StructField("contract", StringType()), StructField("close_nano", LongType()), StructField("market", StringType())])


@query(f"WITH {tables.bars_sql()} SELECT market, event_at_ns, contract, close_nano FROM bars")
def bars_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-06, B-01, B-14, G-01: create-only, partitioned, sorted, read back by exact schema."""
    path = fresh(spark, "bars")
    b = tables.bars(spark, sf_dir).select("market", "event_at_ns", "contract", "close_nano")
    sinks.parquet(b, path, ("market",), ("event_at_ns", "contract"), 10_000)
    return readers.exact(spark, path, BAR_FILE).select("market", "event_at_ns", "contract", "close_nano")


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def published_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-19, B-20: data first, manifest last, verified on reading."""
    path = fresh(spark, "release")
    columns = ["n_nationkey", "n_name", "n_regionkey"]
    sinks.published(tables.table(spark, sf_dir, "nation").select(*columns), path, ["n_regionkey"], columns, ["nation"], {"kind": "reference"})
    return sinks.verified(spark, path, ["n_regionkey"], columns)


@query("""SELECT event_id, user_id FROM events""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-30: interval tables in order, which must not overlap."""
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id")
    return sinks.merged_intervals([e.where("event_id < 400"), e.where("event_id >= 400 AND event_id < 700"), e.where("event_id >= 700")], "event_id")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders""")
def csv_and_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24, B-23: through CSV, JSON lines and an appended ledger."""
    schema = "o_orderkey long, o_custkey long, o_orderstatus string"
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    a, b, c = (fresh(spark, n) for n in ("csv", "json", "ledger"))
    sinks.csv(o, a)
    sinks.json_lines(readers.csv(spark, a, schema), b)
    back = readers.json_lines(spark, b, schema)
    sinks.append(back.where("o_orderkey % 2 = 0"), c)
    sinks.append(back.where("o_orderkey % 2 = 1"), c)
    return spark.read.schema(schema).parquet(c)


@query("""WITH u AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, event_id, -1.0 FROM events WHERE event_id % 10 = 1) SELECT user_id, event_type, arg_max(value, (value < 0)::INT * 1000000000 + event_id) AS value FROM u GROUP BY 1, 2""")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-16: each version is the one before with new rows won over old ones."""
    e = tables.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    path = fresh(spark, "table")
    sinks.upsert(spark, path, e.where("event_id % 2 = 0"), ["user_id", "event_type"], "event_id", 0)
    new = e.where("event_id % 10 = 1").withColumn("value", F.lit(-1.0))
    return sinks.upsert(spark, path, new, ["user_id", "event_type"], "event_id", 1).select("user_id", "event_type", "value")


@query("""SELECT market, n FROM (SELECT event_type AS market, count(*) AS n FROM events GROUP BY 1) WHERE market = 'view'""")
def catalog_resolved_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-07, A-18: one path of a market, year and purpose, or none."""
    catalog = spark.createDataFrame([("view", 2024, f"{sf_dir}/events.parquet", ["research"]), ("view", 2025, "nowhere", ["holdout"])], "market string, year int, path string, purposes array<string>")
    e = readers.projected(spark, readers.resolved(catalog, "view", 2024, "research"), ["event_type"])
    return e.where("event_type = 'view'").groupBy(F.col("event_type").alias("market")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey <> 3 THEN n_regionkey ELSE -1 END AS region, CASE WHEN n_regionkey <> 3 THEN 'DEFINED' ELSE 'UNDEFINED' END AS region_state, CASE WHEN n_regionkey = 3 THEN 'UNDEFINED_VALUE' ELSE 'NONE' END AS defect_code FROM nation""")
def sentinel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-05, A-08: sentinels become nulls with a state, and a defect code for what depends on them."""
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    d = readers.nullified(n, {"region": 3})
    return d.select("n_nationkey", F.coalesce("region", F.lit(-1).cast("long")).alias("region"), "region_state", F.when(F.col("region").isNull(), "UNDEFINED_VALUE").otherwise("NONE").alias("defect_code"))


@query(f"""WITH {tables.TRADES} SELECT market, event_at_ns // {H} * {H} AS bucket_ns, arg_min(price_nano, event_at_ns) AS open_nano, max(price_nano) AS high_nano, min(price_nano) AS low_nano, arg_max(price_nano, event_at_ns) AS close_nano, sum(size)::BIGINT AS volume FROM trades GROUP BY 1, 2""")
def streamed_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-28, M-01: a stream of trades in batches, each aggregated where it is read and added to the market's open candle; the newest form of each candle."""
    source, out, state = (fresh(spark, n) for n in ("trades", "candles", "state"))
    t = tables.trades(spark, sf_dir).select("market", "event_at_ns", "price_nano", "size")
    first, last = t.agg(F.min("event_at_ns"), F.max("event_at_ns")).first()
    part = F.floor((F.col("event_at_ns") - F.lit(first or 0)) * 3 / F.lit((last or 0) - (first or 0) + 1))
    for i in range(3):  # files come in the order of their times, one a batch
        t.where(part == i).coalesce(1).write.mode("append").parquet(source)
    schema = "market string, event_at_ns long, price_nano long, size long"
    live.run_once(live.trades(spark, source, schema, 1), state, live.aggregated(out, H))
    found = spark.read.schema("market string, bucket_ns long, open_nano long, high_nano long, low_nano long, close_nano long, volume long, batch int").parquet(f"{out}/candles")
    return sets.upserted(found.limit(0), found, ["market", "bucket_ns"], "batch").drop("batch")


@query(f"""SELECT event_type AS market, ({1705708800 * 10**9 - 1} - epoch_us(ts) * 1000) // {12 * H} AS chunk, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def chunked_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-29: bounded chunks of time, newest first, each row in one of them."""
    t = tables.trades(spark, sf_dir)
    start, end = 1704067200 * 10**9, 1705708800 * 10**9
    inside = readers.time_range(t, "event_at_ns", start, end).withColumn("chunk", clock.floor_div(F.lit(end - 1) - F.col("event_at_ns"), 12 * H))  # 0 is the newest
    return inside.groupBy("market", "chunk").agg(F.count("*").alias("n"))


@query("""SELECT event_type AS market, CASE WHEN avg(value) FILTER (event_id % 2 = 0) >= avg(value) FILTER (event_id % 2 = 1) THEN 'LONG' ELSE 'SHORT' END AS side, row_number() OVER (ORDER BY abs(avg(value) - 50) DESC, event_type)::INTEGER AS place FROM events GROUP BY 1""")
def ordered_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-07, G-12: the long side wins ties; keys by size, then name."""
    from pyspark.sql import Window

    part = lambda r: F.avg(F.when(F.col("event_id") % 2 == r, F.col("value")))
    g = tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("market")).agg(part(0).alias("a"), part(1).alias("b"), F.avg("value").alias("m"))
    n = F.row_number().over(Window.orderBy(F.desc(F.abs(F.col("m") - 50)), "market"))
    return g.select("market", F.when(F.col("a") >= F.col("b"), "LONG").otherwise("SHORT").alias("side"), n.alias("place"))


@query(f"WITH {tables.TRADES} SELECT '1h' AS timeframe, count(*) AS n FROM (SELECT DISTINCT market, event_at_ns // {H} FROM trades) UNION ALL SELECT '15m', count(*) FROM (SELECT DISTINCT market, event_at_ns // {H // 4} FROM trades)")
def timeframe_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-08, I-09: named timeframes; others are refused."""
    t = tables.trades(spark, sf_dir)
    one = lambda name: bar_ops.candles(t, ["market"], "ts", "price_nano", "size", name).agg(F.count("*").alias("n")).select(F.lit(name).alias("timeframe"), "n")
    return one("1h").union(one("15m"))


@query(
    f"""WITH i AS (SELECT l_returnflag, l_orderkey % 3 AS part, l_quantity AS x0, l_discount AS x1, l_extendedprice / 1000 AS y FROM lineitem), t AS (SELECT i.*, h::BIGINT AS held FROM i, range(0, 3) r(h) WHERE part <> h), {_solved("l_returnflag, held", "t", ["x0", "x1"])}
SELECT i.l_returnflag, part AS held, count(*) AS n, round(avg((y - intercept - w0 * x0 - w1 * x1) ** 2), 3) AS mse FROM i JOIN m ON m.l_returnflag = i.l_returnflag AND m.held = i.part GROUP BY 1, 2"""
)
def crossfit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, Q-04: in each outer fold, models of its inner folds predict what they haven't seen."""
    i = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_orderkey") % 3).alias("inner"))
    train = i.withColumn("held", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3))))).where("inner <> held")
    models = ridge.fit(train, ["l_returnflag", "held"], ["l_quantity", "l_discount"], ["price"], 1.0)
    test = i.withColumnRenamed("inner", "held")
    p = ridge.predicted(test, models, ["l_returnflag", "held"], ["l_quantity", "l_discount"], "price")
    return p.groupBy("l_returnflag", "held").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("price") - F.col("prediction"), 2)), 3).alias("mse"))


@query("""SELECT count(*) AS n, bool_and(l_quantity > 0) AS positive, bool_and(l_tax <= 0.1) AS taxed FROM lineitem""")
def mechanics_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-32: boolean checks over rows."""
    return tables.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.bool_and(F.col("l_quantity") > 0).alias("positive"), F.bool_and(F.col("l_tax") <= 0.1).alias("taxed"))


@query("""SELECT instrument_id, ts_event_ns, volume FROM (SELECT user_id AS instrument_id, epoch_us(ts) * 1000 AS ts_event_ns, 1 AS volume FROM events) WHERE ts_event_ns >= 1704153600000000000 AND ts_event_ns < 1704240000000000000""")
def sql_bar_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-01, A-26: the cache's SQL: create, insert, select a range."""
    tables.trades(spark, sf_dir).createOrReplaceTempView("marlstone_cache_source")
    name = f"bar_cache_{uuid.uuid4().hex}"
    path = fresh(spark, name)
    spark.sql(f"CREATE TABLE {name} (instrument_id BIGINT, ts_event_ns BIGINT, volume INT) USING parquet LOCATION '{path}'")
    spark.sql(f"INSERT INTO {name} SELECT instrument_id, event_at_ns, 1 FROM marlstone_cache_source")
    found = spark.read.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return found.where("ts_event_ns >= 1704153600000000000 AND ts_event_ns < 1704240000000000000")
