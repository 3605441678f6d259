"""Releases by interval: parts with a manifest each, checked before anything is built on them, and merged in order.

A part is what a table holds for one combination of key columns, a market and an interval, say. Its manifest has the
number of rows, the first and last time, a fingerprint, the release that it was made from, and an id over all these.
Parts are checked and built side by side, however many there are; no step goes through them one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes

_BODY = ("rows", "first", "last", "q0", "q1", "q2", "q3")


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def manifest(rows: DataFrame, kind: str, keys: list[str], at: str, columns: list[str], sources: DataFrame | None = None) -> DataFrame:
    """A manifest for each part of ``rows``; ``sources`` (keys, source_id) names the release that a part was made from."""
    quarter = lambda i: F.pmod(F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(1 << 32)).alias(f"q{i}")
    own = rows.withColumn("_h", codes.row_hash(*columns)).groupBy(*keys).agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"), *map(quarter, range(4)))
    if sources is not None:
        own = own.alias("a").join(sources.alias("b"), _same(keys, "a", "b"), "left").select("a.*", "b.source_id")
    else:
        own = own.withColumn("source_id", F.lit(None).cast("string"))
    told = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (*keys, *_BODY, "source_id")]
    return own.withColumn("release_id", F.sha2(F.concat_ws("|", F.lit(kind), *told), 256))


def checked(rows: DataFrame, stated: DataFrame, kind: str, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Each part's state against its manifest: VERIFIED, CHANGED, MISSING (no rows) or UNEXPECTED (no manifest), with its release_id."""
    found = manifest(rows, kind, keys, at, columns)
    both = found.alias("f").join(stated.alias("s"), _same(keys, "f", "s"), "full_outer")
    equal = reduce(lambda a, b: a & b, (F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _BODY))
    state = F.when(F.col("s.release_id").isNull(), "UNEXPECTED").when(F.col("f.release_id").isNull(), "MISSING").when(equal, "VERIFIED").otherwise("CHANGED")
    named = [F.when(F.col("f.release_id").isNull(), F.col(f"s.{k}")).otherwise(F.col(f"f.{k}")).alias(k) for k in keys]
    return both.select(*named, state.alias("state"), F.col("s.release_id").alias("release_id"))


def consumed(rows: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of verified parts, each with the ``source_id`` of its release; no others are given on."""
    good = states.where("state = 'VERIFIED'").select(*keys, F.col("release_id").alias("source_id"))
    return rows.alias("a").join(good.alias("b"), _same(keys, "a", "b")).select("a.*", "b.source_id")


def merged(stated: DataFrame, states: DataFrame, part: list[str], whole: list[str], most: DataFrame | None = None) -> DataFrame:
    """Parts merged into wholes (``whole``, among the columns of ``part``): parts, rows, first, last, refused and state.

    OVERLAP where a part begins before or when one before it ends, INCOMPLETE where a part isn't verified, or ``most``
    (whole, parts) expects more of them, else COMPLETE. The parts of a whole, not their rows, are put in order.
    """
    met = stated.alias("m").join(states.alias("s"), _same(part, "m", "s")).select("m.*", F.col("s.state").alias("_state"))
    before = Window.partitionBy(*whole).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("_state") == "VERIFIED", F.col("last"))
    met = met.withColumn("_over", (F.col("_state") == "VERIFIED") & (F.col("first") <= F.max(good).over(before)))
    ok = F.col("_state") == "VERIFIED"
    out = met.groupBy(*whole).agg(F.count_if(ok).alias("parts"), F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)).alias("rows"), F.min(F.when(ok, F.col("first"))).alias("first"), F.max(good).alias("last"), F.count_if(~ok).alias("refused"), F.count_if("_over").alias("overlaps"))
    expected = F.lit(0)
    if most is not None:
        out = out.alias("a").join(most.alias("b"), _same(whole, "a", "b"), "left").select("a.*", F.coalesce("b.parts", F.lit(0)).alias("_expected"))
        expected = F.col("_expected")
    state = F.when(F.col("overlaps") > 0, "OVERLAP").when((F.col("refused") > 0) | (F.col("parts") < expected), "INCOMPLETE").otherwise("COMPLETE")
    return out.withColumn("state", state).drop("_expected")
