"""Exact order statistics of groups of any size: values are counted, put in order by ranges, and found by prefix counts.

No task holds a group. Equal values become one row with their number before anything is sorted; the rows are dealt by
ranges of (key, value), so that a large group lies in many tasks; each task sums up its counts by key; and the value at
a rank is where the sum over the tasks before, and the rows before, passes it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: From the number of values in a group to the rank that is asked for, from 1.
Rank = Callable[[Column], Column]


def nearest_rank(share: float) -> Rank:
    """Rank ceil(share n), the first for a share of 0."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(share))).cast("long")


def nearest_index(share: float) -> Rank:
    """The index next to share (n - 1), halves to the even one; another rank than ``nearest_rank``."""
    return lambda n: (F.bround((n - 1) * F.lit(share)) + 1).cast("long")


def selected(rows: DataFrame, keys: list[str], x: str, ranks: dict[str, Rank]) -> DataFrame:
    """keys, ``n`` (values that aren't null) and for each name the value at its rank; groups without values are left out.

    Ties are exact, null keys are a group, no keys at all is one group.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    placed = written(counts.repartitionByRange(*keys, "_x").sortWithinPartitions(*keys, "_x").withColumn("_part", F.spark_partition_id()), "counts")
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    parts = parts.withColumn("_before", F.sum("_sum").over(group.orderBy("_part")) - F.col("_sum")).withColumn("n", F.sum("_sum").over(group))
    on = [*keys, "_part"]
    renamed = parts.drop("_sum").withColumnsRenamed({c: f"_at{i}" for i, c in enumerate(on)})
    met = placed.join(renamed, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(on))))
    until = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("_until", until)
    hit = {name: (F.col("_until") >= rank(F.col("n"))) & (F.col("_until") - F.col("_n") < rank(F.col("n"))) for name, rank in ranks.items()}
    found = met.where(reduce(lambda a, b: a | b, hit.values()))  # a row for each rank at most
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(h, F.col("_x"))).alias(name) for name, h in hit.items()))


def coverage(rows: DataFrame, keys: list[str], x: str, levels: list[float]) -> DataFrame:
    """keys, level and how many values lie at or below it, each level once; the levels are a list of the caller's."""
    each = F.explode(F.array(*(F.lit(v) for v in levels))).alias("level")
    own = rows.where(F.col(x).isNotNull()).groupBy(*keys).agg(*(F.count_if(F.col(x) <= v).alias(f"_{i}") for i, v in enumerate(levels)))
    at = reduce(lambda c, i: c.when(F.col("level") == levels[i], F.col(f"_{i}")), range(1, len(levels)), F.when(F.col("level") == levels[0], F.col("_0")))
    return own.select("*", each).select(*keys, "level", at.alias("n"))
