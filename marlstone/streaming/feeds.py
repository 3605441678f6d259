"""Feeds of a live view: focus on one instrument, symbols mapped, updates throttled, batches drained, labels carried on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def focused(stream: DataFrame, focus: DataFrame) -> DataFrame:
    """Trades of the instruments in focus, as long as their generation is the current one; others are late and go.

    ``focus`` (instrument_id, generation) is a static table: what is being looked at. Spark broadcasts it where its
    size, which it knows, allows that.
    """
    return stream.join(focus, ["instrument_id", "generation"])


def mapped(stream: DataFrame, symbols: DataFrame) -> DataFrame:
    """Trades with the symbol that their instrument had at that time; ones without stay and are marked.

    ``symbols`` (instrument_id, symbol, from_ns, to_ns) is a static table of half-open intervals that don't overlap.
    """
    on = (stream["instrument_id"] == symbols["instrument_id"]) & (stream["event_at_ns"] >= symbols["from_ns"]) & (stream["event_at_ns"] < symbols["to_ns"])
    return stream.join(symbols, on, "left").select(*(stream[c] for c in stream.columns), F.coalesce("symbol", F.lit("UNMAPPED")).alias("symbol"))


def throttled(stream: DataFrame, keys: list[str], at: str, order: list[str], interval: int, values: list[str]) -> DataFrame:
    """The last update of each key in every interval, with the number of those that it stands for."""
    last = F.max_by(F.struct(*values), F.struct(at, *order))
    return stream.groupBy(*keys, F.floor(F.col(at) / interval).cast("long").alias("slot")).agg(last.alias("_last"), F.count("*").alias("updates"), F.max(F.struct(at, *order)).alias("_at")).select(*keys, "slot", "_last.*", "updates")


def drained(rows: DataFrame, keys: list[str], at: str, order: list[str], most: int, idle: int) -> DataFrame:
    """``rows`` with the batch they are drawn in: a batch ends after ``most`` rows or where none comes for ``idle``."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > idle).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    inside = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(at, *order)) - 1
    first = runs.withColumn("_inside", inside).withColumn("_first", (F.col("_inside") % most == 0).cast("int"))
    return first.withColumn("batch", F.sum("_first").over(w)).drop("_new", "_run", "_inside", "_first")


def carried(path: str, keys: list[str], order: str, before: int, after: int, label: Callable[[Window], list]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: rows whose window of ``before`` and ``after`` rows is whole are labelled and written.

    The last before + after rows of each key are carried to the next batch, so a label never rests on half a window,
    and it doesn't matter where batches end. Each batch writes its carry beside its labels under its own number, so
    one that is given again replaces itself.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        seen = batch
        if number:
            seen = spark.read.schema(batch.schema).parquet(f"{path}/carry/batch={number - 1}").unionByName(seen)
        w = Window.partitionBy(*keys).orderBy(order)
        n = seen.withColumn("_back", F.row_number().over(w)).withColumn("_left", F.count("*").over(Window.partitionBy(*keys)) - F.col("_back"))
        out = n.select(*keys, order, *label(w), "_back", "_left")
        whole = out.where((F.col("_back") > before) & (F.col("_left") >= after)).drop("_back", "_left")
        whole.write.mode("overwrite").parquet(f"{path}/labels/batch={number}")
        n.where(F.col("_left") < before + after).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/carry/batch={number}")

    return sink

