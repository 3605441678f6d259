"""Structured Streaming: candles from trades, staleness, upserts.

A trade older than the last one of its stream is dropped and counted, which a watermark can't say: it's state per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import clock

_OUT = "market string, bucket_ns long, open_nano long, high_nano long, low_nano long, close_nano long, volume long, ignored long"
_STATE = "last_ns long, bucket_ns long, open_nano long, high_nano long, low_nano long, close_nano long, volume long, ignored long"


def trades(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def candles(stream: DataFrame, step: int) -> DataFrame:
    """Candles of ``stream`` (market, event_at_ns, price_nano, size), each batch's touched ones in their newest form.

    Trades are taken in order of time within a batch. One older than the market's last trade is ignored and counted.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, bucket, o, h, low, c, v, ignored = state.get if state.exists else (-1, -1, 0, 0, 0, 0, 0, 0)
        out: dict[int, tuple] = {}
        rows = pd.concat(list(batches)).sort_values("event_at_ns", kind="stable")
        for at, price, size in zip(rows["event_at_ns"].tolist(), rows["price_nano"].tolist(), rows["size"].tolist(), strict=True):
            if at < last:
                ignored += 1
                continue
            last = at
            if at // step * step != bucket:
                bucket, o, h, low, c, v = at // step * step, price, price, price, price, 0
            h, low, c, v = max(h, price), min(low, price), price, v + size
            out[bucket] = (key[0], bucket, o, h, low, c, v, ignored)
        state.update((last, bucket, o, h, low, c, v, ignored))
        yield pd.DataFrame(list(out.values()), columns=[x.split()[0] for x in _OUT.split(", ")])

    return stream.groupBy("market").applyInPandasWithState(work, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


_STORED = "market string, bucket_ns long, open_nano long, high_nano long, low_nano long, close_nano long, volume long"


def aggregated(path: str, step: int) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that makes the same candles by aggregation, so that one market is the work of many tasks.

    What a market's batch needs of those before it is small: its last trade's time, and the candle that is open. A
    trade before that time is ignored and counted, the others of a batch and bucket are combined where they are read,
    and the open candle is met only by the sums. Candles and state are written under the batch's number, so a batch
    that is given again replaces itself.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kinds = f"{_STORED}, last_ns long, ignored long"
        before = spark.read.schema(kinds).parquet(f"{path}/state/batch={number - 1}") if number else spark.createDataFrame([], kinds)
        last = before.select(F.col("market").alias("_market"), F.col("last_ns").alias("_last"))
        told = batch.join(last, F.col("market").eqNullSafe(F.col("_market")), "left").withColumn("late", F.coalesce(F.col("event_at_ns") < F.col("_last"), F.lit(False)))
        bucket = clock.floor_to("event_at_ns", step)
        price, at, fresh = F.col("price_nano"), F.col("event_at_ns"), told.where("not late")
        own = fresh.groupBy("market", bucket.alias("bucket_ns")).agg(
            F.min_by(price, at).alias("open_nano"), F.max(price).alias("high_nano"), F.min(price).alias("low_nano"), F.max_by(price, at).alias("close_nano"), F.sum("size").alias("volume"), F.max(at).alias("last_ns"))
        old = before.select(*(F.col(c).alias(f"_{c}") for c in before.columns))
        same = F.col("market").eqNullSafe(F.col("_market")) & (F.col("bucket_ns") == F.col("_bucket_ns"))
        met = own.join(old.drop("_ignored", "_last_ns", "_close_nano"), same, "left")
        made = met.select("market", "bucket_ns", F.coalesce("_open_nano", "open_nano").alias("open_nano"), F.greatest("high_nano", "_high_nano").alias("high_nano"), F.least("low_nano", "_low_nano").alias("low_nano"), "close_nano", (F.col("volume") + F.coalesce("_volume", F.lit(0))).alias("volume"), "last_ns")
        made.drop("last_ns").write.mode("overwrite").parquet(f"{path}/candles/batch={number}")
        late = told.groupBy("market").agg(F.count_if("late").alias("ignored"))
        newest = made.unionByName(before.drop("ignored")).groupBy("market").agg(F.max_by(F.struct(*made.columns[1:]), F.struct("bucket_ns", "volume")).alias("_s")).select("market", "_s.*")
        counts = late.unionByName(before.select("market", "ignored")).groupBy("market").agg(F.sum("ignored").alias("ignored")).withColumnRenamed("market", "_market")
        state = newest.join(counts, F.col("market").eqNullSafe(F.col("_market")), "left").drop("_market")
        state.select(*(c.split()[0] for c in kinds.split(", "))).write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    return sink


def windowed(stream: DataFrame, ts: str, duration: str, delay: str) -> DataFrame:
    """Candles by event-time window, final once the watermark has passed."""
    return stream.withWatermark(ts, delay).groupBy("market", F.window(ts, duration)).agg(
        F.min_by("price_nano", ts).alias("open_nano"), F.max("price_nano").alias("high_nano"), F.min("price_nano").alias("low_nano"), F.max_by("price_nano", ts).alias("close_nano"), F.sum("size").alias("volume"))


def stale(latest: DataFrame, now: int, most_age: int) -> DataFrame:
    """Markets by the age of their latest bar."""
    age = F.lit(now) - F.col("last_ns")
    return latest.withColumn("age_ns", age).withColumn("state", F.when(age > most_age, "STALE").otherwise("LIVE"))


def replay_start(watermarks: DataFrame, earliest: int) -> DataFrame:
    """Where each instrument's next replay begins: its watermark, but not before what may be asked for."""
    return watermarks.withColumn("replay_from_ns", F.greatest(F.lit(earliest).cast("long"), F.coalesce("watermark_ns", F.lit(earliest).cast("long"))))


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Work off all that is there, batch by batch; a batch may be given to ``sink`` again after a failure."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
