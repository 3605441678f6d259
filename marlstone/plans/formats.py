"""Queries over files of other formats that this library writes and reads in parts: binary records, numbered lines; and exact ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks
from ..sources import ranges, readers
from ..sources.scratch import fresh, written
from . import tables
from .registry import query

_FIELDS = {"part": "u1", "event_id": "i8", "instrument_id": "i4", "event_at_ns": "i8", "price_nano": "i8", "flags": "u2"}


def _records(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    """The trade tape in binary files in the order of part and time, some records twice, some prices undefined; read by ranges of ``rows``.

    A part may lie in several files and share one with another; ``place`` is a record's place in its part.
    """
    t = tables.trades(spark, sf_dir)
    price = F.when(F.col("event_id") % 23 == 7, F.lit((1 << 63) - 1)).otherwise(F.col("price_nano"))
    r = t.select((F.col("event_id") % 3).alias("part"), "event_id", "instrument_id", "event_at_ns", price.alias("price_nano"), (F.col("event_id") % 1000).alias("flags"))
    r = r.union(r.where("event_id % 31 = 4"))
    path, order = fresh(spark, "records"), ["part", "event_at_ns", "event_id"]
    ranges.write_records(r.repartitionByRange(*order).sortWithinPartitions(*order), path, _FIELDS, b"MARL1\n")
    found = ranges.ranged_records(spark, path, _FIELDS, None, b"MARL1\n", rows)
    files = found.groupBy("file", "part").agg(F.min("ordinal").alias("first"), F.count("*").alias("n"), F.min(F.struct("event_at_ns", "event_id")).alias("begins"))
    before = Window.partitionBy("part").orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    return found.join(starts, ["file", "part"]).withColumn("place", F.col("ordinal") + F.col("start")).drop("start")


_R = f"""{tables.TRADES}, u AS (SELECT event_id % 3 AS part, event_id, instrument_id, event_at_ns, CASE WHEN event_id % 23 = 7 THEN 9223372036854775807 ELSE price_nano END AS price_nano, event_id % 1000 AS flags, unnest(range(CASE WHEN event_id % 31 = 4 THEN 2 ELSE 1 END)) AS copy FROM trades),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_at_ns, event_id, copy) - 1 AS place FROM u)"""


@query(f"""WITH {_R} SELECT part, place, event_id, instrument_id::INTEGER AS instrument_id, event_at_ns, price_nano, flags::INTEGER AS flags, (place = 0 OR place % 500 = 0) AS begins FROM r""")
def binary_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11, A-12: fixed-width records of several files, each read by many tasks; the files of a part are one after the other."""
    r = _records(spark, sf_dir, 500)
    place = F.col("place")
    return r.select(F.col("part").cast("long").alias("part"), "place", "event_id", "instrument_id", "event_at_ns", "price_nano", F.col("flags").cast("int").alias("flags"), (place % 500 == 0).alias("begins"))


@query(
    f"""WITH {_R}, l AS (SELECT *, lag(instrument_id) OVER (PARTITION BY part ORDER BY place) AS was FROM r)
SELECT part, count(*) AS records, count(*)::BIGINT * 31 AS bytes, count(*) FILTER (price_nano = 9223372036854775807) AS undefined, count(DISTINCT instrument_id) AS identities, count(*) FILTER (was <> instrument_id) AS rolls, min(event_at_ns) AS "first", max(event_at_ns) AS "last", count(*) - count(DISTINCT event_id) AS repeated FROM l GROUP BY part"""
)
def binary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17: records decoded to Parquet within a budget of bytes, with counts of repeats, undefined values, identities and rolls from all ranges."""
    r = _records(spark, sf_dir, 700).withColumns({"file": F.col("part").cast("string"), "ordinal": F.col("place")})  # a part is one file in several
    kept = ranges.decoded_to_parquet(r, fresh(spark, "decoded"), 1 << 40, ["file", "ordinal", "part", "instrument_id", "event_at_ns", "price_nano", "raw"])
    found = ranges.counters(kept, ["part"], "instrument_id", "event_at_ns", {"price_nano": (1 << 63) - 1}, 300)
    return found.withColumn("part", F.col("part").cast("long"))


_LINE = "concat('{\"event_id\":', event_id, ',\"kind\":\"', event_type, '\"}')"


@query(
    f"""WITH e AS (SELECT event_id % 4 AS part, event_id, CASE WHEN event_id % 37 = 5 THEN '' WHEN event_id % 41 = 6 THEN 'no object' ELSE {_LINE} END AS line, copy FROM (SELECT *, unnest(range(CASE WHEN event_id % 29 = 3 THEN 2 ELSE 1 END)) AS copy FROM events)),
n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_id, copy) AS line_number FROM e)
SELECT part, line_number, sha256(line) AS line_sha256, CASE WHEN line = '' THEN 'BLANK' WHEN line = 'no object' THEN 'INVALID' WHEN copy = 1 THEN 'DUPLICATE' ELSE 'OK' END AS state, CASE WHEN line LIKE '{{%' THEN event_id ELSE -1 END AS event_id FROM n"""
)
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24: JSON lines with their numbers in the file, whatever splits it is read in, their hashes, and what is wrong with them."""
    i = F.col("event_id")
    line = F.when(i % 37 == 5, "").when(i % 41 == 6, "no object").otherwise(F.expr(_LINE))
    copies = F.explode(F.sequence(F.lit(0), F.when(i % 29 == 3, 1).otherwise(0))).alias("copy")
    e = tables.table(spark, sf_dir, "events").select((i % 4).alias("part"), "event_id", line.alias("value"), copies)
    path = fresh(spark, "lines")
    e.repartition(4, "part").sortWithinPartitions("part", "event_id", "copy").select("part", "value").write.partitionBy("part").text(path)
    key, was = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    spark.conf.set(key, str(readers.split_bytes(size)))  # many splits a file
    try:
        found = written(readers.numbered_json_lines(spark, path, "event_id long, kind string"), "numbered")
    finally:
        spark.conf.set(key, was)
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return found.select(part.alias("part"), "line_number", "line_sha256", "state", F.coalesce("record.event_id", F.lit(-1).cast("long")).alias("event_id"))


_SHARES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


@query(
    f"""WITH x AS (SELECT 'all' AS "group", round(l_extendedprice) AS x FROM lineitem UNION ALL SELECT l_returnflag, l_quantity FROM lineitem)
SELECT "group", count(*) AS n, {', '.join(f"quantile_disc(x, {p}) AS p{round(100 * p)}" for p in _SHARES)} FROM x GROUP BY 1"""
)
def exact_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-07, E-09: nearest-rank percentiles where one group is a whole table and others are mostly ties, by prefix counts over ranges."""
    li = tables.table(spark, sf_dir, "lineitem")
    x = li.select(F.lit("all").alias("group"), F.round("l_extendedprice").alias("x")).union(li.select("l_returnflag", F.col("l_quantity").cast("double")))
    return ranks.selected(x, ["group"], "x", {f"p{round(100 * p)}": ranks.nearest_rank(p) for p in _SHARES})


@query("""SELECT o_orderpriority, level, count(*) FILTER (o_totalprice <= level) AS n FROM orders, (VALUES (50000.0), (150000.0), (300000.0)) v(level) WHERE o_totalprice IS NOT NULL GROUP BY 1, 2""")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-07: how many values lie at or below each level, in one pass."""
    return ranks.coverage(tables.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [50_000.0, 150_000.0, 300_000.0])
