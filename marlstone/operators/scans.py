"""Scans along the rows of a key whose steps compose: a key is cut into blocks, and many tasks work on one key.

What a stretch of rows does to the state before it is itself a small value, and two such values in a row are one again
(sums add up, a peak moves by the sum before it, decays multiply). So each block is worked off on its own, the blocks'
values are carried from one block to the next, and each row combines what was carried with its place in the block. Only
blocks, not rows, meet in the tasks of one key. A block holds the rows whose first order column lies in one ``span``;
rows that are equal in it are never parted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import clock
from .sequences import folded

#: Width of a block in units of the first order column, where the caller knows of no better one.
SPAN = 4_096


def blocked(rows: DataFrame, keys: list[str], order: list[str], span: int) -> tuple[DataFrame, WindowSpec]:
    """``rows`` with ``_block``, and the window over the rows of a key and block in their order."""
    return rows.withColumn("_block", clock.floor_div(F.col(order[0]).cast("long"), span)), Window.partitionBy(*keys, "_block").orderBy(*order)


def _met(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what was carried to their key and block; null keys are keys."""
    on = [*keys, "_block"]
    renamed = carried.withColumnsRenamed({c: f"_at{i}" for i, c in enumerate(on)})
    return rows.join(renamed, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(on)))).drop(*(f"_at{i}" for i in range(len(on))))


def carried(rows: DataFrame, keys: list[str], summary: list[Column], carry: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """Blocked ``rows`` with ``carry`` over the summaries of the blocks before theirs; of the first block it's null."""
    blocks = rows.groupBy(*keys, "_block").agg(*summary)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return _met(rows, blocks.select(*keys, "_block", *carry(before)), keys)


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], span: int = SPAN) -> DataFrame:
    """``rows`` with each column's value in the row before, under the name given; null in the first row of a key."""
    b, w = blocked(rows, keys, order, span)
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    met = carried(b, keys, [last], lambda before: [F.last("_last").over(before).alias("_was")])
    own = F.lag(F.struct(*columns)).over(w)
    return met.withColumn("_was", F.coalesce(own, F.col("_was"))).select(*rows.columns, *(F.col(f"_was.{c}").alias(name) for c, name in columns.items()))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, span: int = SPAN) -> DataFrame:
    """``rows`` numbered from 1 in each key's order."""
    b, w = blocked(rows, keys, order, span)
    met = carried(b, keys, [F.count("*").alias("_n")], lambda before: [F.sum("_n").over(before).alias("_before")])
    return met.withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(w)).drop("_block", "_before")


def lifted(rows: DataFrame, keys: list[str], order: list[str], add: Column, lift: Column, span: int = SPAN) -> DataFrame:
    """``rows`` with ``before``, the sum of ``add`` over the rows before, and ``peak``, the largest ``before + lift`` so far.

    A block's value is its sum and its own peak; a peak moves by the sums before its block.
    """
    b, w = blocked(rows.withColumns({"_add": add, "_lift": lift}), keys, order, span)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_in", F.sum("_add").over(so_far) - F.col("_add"))
    b = b.withColumn("_top", F.max(F.col("_in") + F.col("_lift")).over(so_far))
    blocks = b.groupBy(*keys, "_block").agg(F.sum("_add").alias("_sum"), F.max("_top").alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_high", F.max(F.col("_base") + F.col("_most")).over(earlier))
    met = _met(b, blocks.select(*keys, "_block", "_base", "_high"), keys)
    return met.withColumn("before", F.col("_base") + F.col("_in")).withColumn("peak", F.greatest("_high", F.col("_base") + F.col("_top"))).drop("_add", "_lift", "_block", "_in", "_top", "_base", "_high")


def after_first(rows: DataFrame, keys: list[str], order: list[str], flag: str, name: str, span: int = SPAN) -> DataFrame:
    """``rows`` with ``name``: how many rows before have ``flag``; null flags count as false."""
    b, w = blocked(rows, keys, order, span)
    one = F.coalesce(F.col(flag).cast("long"), F.lit(0))
    met = carried(b, keys, [F.sum(one).alias("_n")], lambda before: [F.sum("_n").over(before).alias("_before")])
    inside = F.sum(one).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce(inside, F.lit(0))).drop("_block", "_before")


def latest(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, span: int = SPAN) -> DataFrame:
    """``rows`` with the last value that isn't null up to each, in the key's order."""
    b, w = blocked(rows.withColumn("_value", value), keys, order, span)
    inside = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    newest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_newest")
    met = carried(b, keys, [newest], lambda before: [F.last("_newest", ignorenulls=True).over(before).alias("_before")])
    return met.withColumn(name, F.coalesce(inside, "_before")).drop("_value", "_block", "_before")


def decay_span(rate: float, step: int) -> int:
    """Width of blocks, in units of ``step``, inside which powers of ``rate`` stay within doubles."""
    return step * max(1, min(1_000, int(300 / -math.log(rate)) if 0 < rate < 1 else 1_000))


def decayed(rows: DataFrame, keys: list[str], order: list[str], value: Column, age: Column, rate: float, name: str, span: int) -> DataFrame:
    """``rows`` with the sum, over all rows so far, of ``value * rate ** (age of this row - age of that row)``.

    ``age`` doesn't fall along a key, and rises by at most what ``decay_span`` allows within a block. A block is an
    affine map of the sum before it: it is scaled by a power of ``rate``, and the block's own sum is added.
    """
    b, w = blocked(rows.withColumns({"_value": value.cast("double"), "_age": age.cast("long")}), keys, order, span)
    whole = Window.partitionBy(*keys, "_block")
    at = F.col("_age") - F.min("_age").over(whole)
    power = lambda n: F.pow(F.lit(float(rate)), n)
    b = b.withColumn("_at", at).withColumn("_own", F.sum(F.col("_value") * power(-F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) * power(F.col("_at")))
    blocks = b.groupBy(*keys, "_block").agg(F.max("_age").alias("_age"), F.max_by("_own", F.struct(*order)).alias("_own"))

    def step(state: tuple[int, float], row: tuple) -> tuple[tuple[int, float], tuple[int, float]]:
        age, total = state
        now, own = int(row[-2]), float(row[-1])
        return (now, total * rate ** max(now - age, 0) + own), (age, total)

    maps = blocks.select(*keys, "_block", "_age", "_own")
    before = folded(maps.withColumnRenamed("_block", "block"), keys, ["block"], lambda: (0, 0.0), step, [*keys, "block"], "carried_age long, carried double").withColumnRenamed("block", "_block")
    met = _met(b, before, keys)
    total = F.col("_own") + F.when(F.col("carried") != 0, F.col("carried") * power(F.greatest(F.col("_age") - F.col("carried_age"), F.lit(0)))).otherwise(0.0)
    return met.withColumn(name, total).drop("_value", "_age", "_block", "_at", "_own", "carried", "carried_age")
