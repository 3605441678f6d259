"""The library's tables as views over the driver's tables, and the same views in DuckDB SQL.

events stand in for a trade tape (market = event_type, price = value, account and instrument = user_id); a contract
lasts a week, so that rolls occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import bars as bar_ops

WEEK = 7 * clock.DAY
LATENCY = 5 * clock.SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its timestamps have no zone and count as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = clock.ns("ts")
    return e.select(
        "event_id", F.col("event_type").alias("market"), F.col("user_id").alias("instrument_id"), "ts", at.alias("event_at_ns"), "value",
        F.round(F.col("value") * 1e9).cast("long").alias("price_nano"), F.lit(1).cast("long").alias("size"),
        F.concat("event_type", F.lit("-"), clock.floor_div(at, WEEK).cast("string")).alias("contract"))


TRADES = f"""trades AS (SELECT event_id, event_type AS market, user_id AS instrument_id, ts, epoch_us(ts) * 1000 AS event_at_ns, value,
  round(value * 1e9)::BIGINT AS price_nano, 1::BIGINT AS size, event_type || '-' || ((epoch_us(ts) * 1000) // {WEEK})::VARCHAR AS contract FROM events)"""


def bars(spark: SparkSession, sf_dir: str, step: int = clock.HOUR) -> DataFrame:
    made = bar_ops.ohlcv(trades(spark, sf_dir), ["market", "contract"], "event_at_ns", "price_nano", "size", step, "event_id")
    return made.withColumn("available_at_ns", clock.available_at("event_at_ns", step, LATENCY)).withColumn("session", clock.session_date(clock.ts("event_at_ns")).cast("string"))


def bars_sql(step: int = clock.HOUR) -> str:
    return f"""{TRADES}, bars AS (SELECT *, event_at_ns + {step + LATENCY} AS available_at_ns,
  CAST((make_timestamp(event_at_ns // 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') + INTERVAL 7 HOUR AS DATE)::VARCHAR AS session FROM (
  SELECT market, contract, event_at_ns // {step} * {step} AS event_at_ns, arg_min(price_nano, (event_at_ns, event_id)) AS open_nano, max(price_nano) AS high_nano,
  min(price_nano) AS low_nano, arg_max(price_nano, (event_at_ns, event_id)) AS close_nano, sum(size)::BIGINT AS volume FROM trades GROUP BY market, contract, event_at_ns // {step}))"""
