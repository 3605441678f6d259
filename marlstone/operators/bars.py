"""Bars: aggregation, validity, coverage, gaps, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, codes


def ohlcv(rows: DataFrame, keys: list[str], at: str, price: str, size: str, step: int, ordinal: str | None = None) -> DataFrame:
    """Bars of a fixed step: first, highest, lowest and last price by time, and the sum of sizes.

    Rows of one time are in the order of ``ordinal``, such as their place in the file.
    """
    order = F.struct(at, ordinal) if ordinal else F.col(at)
    return rows.groupBy(*keys, clock.floor_to(at, step).alias("event_at_ns")).agg(*_prices(order, price, price, price, price, size))


def reaggregated(bars: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Coarser bars from bars."""
    return bars.groupBy(*keys, clock.floor_to("event_at_ns", step).alias("bucket_ns")).agg(*_prices("event_at_ns", "open_nano", "high_nano", "low_nano", "close_nano", "volume"))


def candles(trades: DataFrame, keys: list[str], ts: str, price: str, size: str, timeframe: str, ordinal: str | None = None) -> DataFrame:
    """Candles of a named timeframe; see clock.bucket. Trades of one time are in the order of ``ordinal``."""
    order = F.struct(ts, ordinal) if ordinal else F.col(ts)
    return trades.groupBy(*keys, clock.bucket(ts, timeframe).alias("bucket")).agg(*_prices(order, price, price, price, price, size))


def _prices(at: str | Column, open_: str, high: str, low: str, close: str, size: str) -> list[Column]:
    return [F.min_by(open_, at).alias("open_nano"), F.max(high).alias("high_nano"), F.min(low).alias("low_nano"), F.max_by(close, at).alias("close_nano"), F.sum(size).alias("volume")]


def valid() -> Column:
    """Positive prices, the high above and the low below both ends, and no negative volume."""
    o, h, low, c = (F.col(x) for x in ("open_nano", "high_nano", "low_nano", "close_nano"))
    return (F.least(o, h, low, c) > 0) & (h >= F.greatest(o, c)) & (low <= F.least(o, c)) & (F.col("volume") >= 0)


def disposition(least_volume: int = 1) -> Column:
    """ELIGIBLE, or the first failure; rows are never dropped."""
    code = codes.first_reason(
        (F.col("open_nano").isNotNull(), "MISSING_PRICE"), (valid(), "INVALID_PRICES"), (F.col("available_at_ns") >= F.col("event_at_ns"), "ACAUSAL"), (F.col("volume") >= least_volume, "THIN"))
    return F.coalesce(code, F.lit("ELIGIBLE"))


def features(ok: Column) -> list[Column]:
    """Mechanical features of one bar; null unless it is eligible."""
    o, h, low, c = (F.col(x) for x in ("open_nano", "high_nano", "low_nano", "close_nano"))
    ok = ok & (o > 0) & (h >= low)
    return [F.when(ok, (c - o) / o).alias("bar_body_fraction"), F.when(ok, c / o - 1).alias("bar_return"), F.when(ok, (h - low) / o).alias("intrabar_range_fraction")]


def islands(intervals: DataFrame, keys: list[str], start: str, end: str, slack: int = 0) -> DataFrame:
    """Union of half-open intervals per key, those at most ``slack`` apart joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(start) > reach + slack)).cast("int")
    marked = intervals.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island")


def gaps(covered: DataFrame, keys: list[str], start: str, end: str, first: int, last: int) -> DataFrame:
    """What merged intervals leave open in [first, last); a key without any isn't listed."""
    inside = covered.where((F.col(end) > first) & (F.col(start) < last))
    w = Window.partitionBy(*keys).orderBy(start)
    after = inside.select(*keys, F.col(end).alias("gap_start"), F.coalesce(F.lead(start).over(w), F.lit(last)).alias("gap_end"))
    before = inside.groupBy(*keys).agg(F.lit(first).cast("long").alias("gap_start"), F.min(start).alias("gap_end"))
    return after.unionByName(before).where("gap_start < gap_end")


def missing_steps(bars: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Steps between each key's first and last bar that have none."""
    span = bars.groupBy(*keys).agg(F.min("event_at_ns").alias("a"), F.max("event_at_ns").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("event_at_ns"))
    return grid.join(bars.select(*keys, "event_at_ns").distinct(), [*keys, "event_at_ns"], "left_anti")


def order_breaks(bars: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that don't come strictly after the row before in their key, told by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return bars.withColumn("_was", F.lag(F.struct(*order)).over(w)).where(F.col("_was") >= F.struct(*order)).drop("_was")


def census(bars: DataFrame, by: list[str], state: str) -> DataFrame:
    """Counts by state with first and last event, in one pass."""
    return bars.groupBy(*by, state).agg(F.count("*").alias("n"), F.min("event_at_ns").alias("first_ns"), F.max("event_at_ns").alias("last_ns"))
