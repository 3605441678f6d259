"""Duplicates, upserts, reconciliation, catalogs and certificates."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from . import ranks
from .sequences import folded


def duplicates(rows: DataFrame, keys: list[str], meaning: list[str]) -> DataFrame:
    """Per key: UNIQUE, EXACT_DUPLICATE or DISTINCT_UPDATE, told by a hash of what the rows mean."""
    hashed = rows.withColumn("_h", codes.row_hash(*meaning))
    n, kinds = F.count("*"), F.count_distinct("_h")
    return hashed.groupBy(*keys).agg(n.alias("n"), F.when(n == 1, "UNIQUE").when(kinds == 1, "EXACT_DUPLICATE").otherwise("DISTINCT_UPDATE").alias("kind"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union in which new rows win over old ones of their key, and later new ones over earlier."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_p"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def same_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n): rows that one side has and the other lacks, as multisets. No rows: the sides are equal."""
    side = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return side(left, right, "left").union(side(right, left, "right")).where("n > 0")


def fingerprint(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Count and an order-free fingerprint per key: sums of the row hashes' four quarters, modulo 2**32 each."""
    h = codes.row_hash(*columns)
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long"))
    quarter = [F.pmod(part(i), F.lit(2**32)).alias(f"q{i}") for i in range(4)]
    return rows.withColumn("_h", h).groupBy(*keys).agg(F.count("*").alias("n"), *quarter)


def catalog_update(current: DataFrame, proposed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """INITIAL, APPEND_ONLY, FULL_SUCCESSOR or UNCHANGED for a proposed catalog, in one row."""
    a = current.select(*keys, F.struct(*values).alias("_a"))
    b = proposed.select(*keys, F.struct(*values).alias("_b"))
    j = a.join(b, keys, "full_outer")
    gone = F.sum((F.col("_b").isNull() | (F.col("_a").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b")))).cast("int"))
    new, old = F.sum(F.col("_a").isNull().cast("int")), F.sum(F.col("_a").isNotNull().cast("int"))
    mode = F.when(F.coalesce(old, F.lit(0)) == 0, "INITIAL").when(gone > 0, "FULL_SUCCESSOR").when(new > 0, "APPEND_ONLY").otherwise("UNCHANGED")
    return j.agg(mode.alias("mode"), F.coalesce(new, F.lit(0)).alias("added"), F.coalesce(gone, F.lit(0)).alias("changed"))


def percentiles(rows: DataFrame, keys: list[str], x: str, shares: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles: the value at rank ceil(p n), the least for p = 0; groups may be of any size."""
    return ranks.selected(rows, keys, x, {f"p{round(100 * p)}": ranks.nearest_rank(p) for p in shares}).drop("n")


def coverage_gate(rows: DataFrame, keys: list[str], parts: dict[str, Column], least: dict[str, float]) -> DataFrame:
    """Shares of rows per key that each part covers, and whether all reach their least."""
    shares = {k: F.avg(v.cast("double")) for k, v in parts.items()}
    ok = F.lit(True)
    for k, v in shares.items():
        ok = ok & (v >= least[k])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in shares.items()), ok.alias("passed"))


def hash_chain(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``link``: SHA-256 of the link before and the row's own hash, per ledger.

    A chain is sequential by nature, so each ledger is folded in order; ledgers are independent.
    """
    own = rows.withColumn("row_hash", codes.row_hash(*columns))

    def step(head: str, row) -> tuple[str, tuple]:
        head = hashlib.sha256((head + row.row_hash).encode()).hexdigest()
        return head, (head,)

    return folded(own, keys, [order], str, step, rows.columns, "link string")
