"""Queries on certificates in levels, commits between writers, and bootstraps replayed in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import draws, trees
from ..sources.commits import ConflictError, Table
from ..sources.scratch import fresh
from . import tables
from .registry import query

H = clock.HOUR
_T0 = 1704067200 * 10**9
_SPAN, _FAN, _LEVELS = 2 * H, 8, 4

_SIDES = f"""{tables.TRADES}, a AS (SELECT market, event_id, event_at_ns, price_nano FROM trades),
b AS (SELECT market, event_id, event_at_ns, price_nano + CASE WHEN event_id % 97 = 5 AND event_at_ns < {_T0 + 60 * H} THEN 1 ELSE 0 END AS price_nano FROM trades WHERE NOT (event_id % 89 = 7 AND event_at_ns < {_T0 + 200 * H})
  UNION ALL SELECT market, event_id + 10000000000, event_at_ns, price_nano FROM trades WHERE event_id % 211 = 11 UNION ALL SELECT market, event_id, event_at_ns, price_nano FROM trades WHERE event_id % 307 = 13),
d AS (SELECT coalesce(x.market, y.market) AS market, coalesce(x.event_id, y.event_id) AS event_id, coalesce(x.event_at_ns, y.event_at_ns) AS event_at_ns, CASE WHEN y.n IS NULL THEN 'LEFT_ONLY' WHEN x.n IS NULL THEN 'RIGHT_ONLY' WHEN x.p <> y.p THEN 'CHANGED' WHEN x.n <> y.n THEN 'REPEATED' END AS state
  FROM (SELECT market, event_id, any_value(event_at_ns) AS event_at_ns, count(*) AS n, min(price_nano) AS p FROM a GROUP BY 1, 2) x FULL JOIN (SELECT market, event_id, any_value(event_at_ns) AS event_at_ns, count(*) AS n, min(price_nano) AS p FROM b GROUP BY 1, 2) y ON x.market = y.market AND x.event_id = y.event_id)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A table and another that should be the same, both stored by leaf: some early prices differ, some rows are gone, new, or there twice."""
    t = tables.trades(spark, sf_dir).select("market", "event_id", "event_at_ns", "price_nano")
    i, at = F.col("event_id"), F.col("event_at_ns")
    other = t.where(~((i % 89 == 7) & (at < _T0 + 200 * H))).withColumn("price_nano", F.col("price_nano") + F.when((i % 97 == 5) & (at < _T0 + 60 * H), 1).otherwise(0))
    other = other.union(t.where("event_id % 211 = 11").withColumn("event_id", i + 10_000_000_000)).union(t.where("event_id % 307 = 13"))
    out = []
    for side in (t, other):
        path = fresh(spark, "side")
        day = clock.floor_div("event_at_ns", clock.DAY)
        side.withColumn("day", day).repartition("day").sortWithinPartitions("event_at_ns").write.partitionBy("day").parquet(path)
        out.append(spark.read.parquet(path))
    return out[0], out[1]


_TREE = ["market"], "event_at_ns", ["market", "event_id", "event_at_ns", "price_nano"], _SPAN, _FAN, _LEVELS


@query(f"WITH {_SIDES} SELECT market, event_id, state FROM d WHERE state IS NOT NULL")
def tree_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01, O-03: two tables compared by fingerprints from the root down; the rows that differ are named, and only their ranges are read again."""
    left, right = _sides(spark, sf_dir)
    seen = trees.descended(trees.tree(left, *_TREE), trees.tree(right, *_TREE), ["market"], _FAN, _LEVELS)
    return trees.differing_rows(left, right, ["market"], "event_at_ns", ["market", "event_id"], ["price_nano"], seen, _SPAN)


def _visits() -> str:
    """Nodes by level: all at the top, below that those whose parent holds a difference."""
    parts = []
    for i in range(_LEVELS):
        own, up = f"event_at_ns // {_SPAN} // {_FAN**i}", f"event_at_ns // {_SPAN} // {_FAN ** (i + 1)}"
        below = "" if i == _LEVELS - 1 else f"WHERE (market, {up}) IN (SELECT (market, {up}) FROM d WHERE state IS NOT NULL)"
        parts.append(f"SELECT market, {i} AS level, count(DISTINCT {own}) AS compared FROM e {below} GROUP BY 1")
    return f"""WITH {_SIDES}, e AS (SELECT market, event_at_ns FROM a UNION ALL SELECT market, event_at_ns FROM b), v AS ({' UNION ALL '.join(parts)})
SELECT market, sum(compared)::BIGINT AS compared, (SELECT count(DISTINCT event_at_ns // {_SPAN}) FROM d WHERE d.market = v.market AND state IS NOT NULL) AS leaves, CASE WHEN market IN (SELECT market FROM d WHERE state IS NOT NULL) THEN 'DIFFERENT' ELSE 'CERTIFIED' END AS state FROM v GROUP BY market"""


@query(_visits())
def tree_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-09: how many nodes were compared before each market was certified or its differing leaves were known."""
    left, right = _sides(spark, sf_dir)
    seen = trees.descended(trees.tree(left, *_TREE), trees.tree(right, *_TREE), ["market"], _FAN, _LEVELS)
    return trees.certified(seen, ["market"])


@query(
    """WITH w AS (SELECT event_type, event_id % 4 AS writer, event_id // 8 AS slot, event_id, value FROM events), first AS (SELECT event_type, slot, event_id, value FROM w WHERE writer = 0),
u AS (SELECT event_type, slot, event_id, value, 0 AS p FROM first UNION ALL SELECT event_type, slot, event_id, value, 2 FROM w WHERE writer = 1 AND event_type IN ('click', 'view') UNION ALL SELECT event_type, slot, event_id, -value, 1 FROM w WHERE writer = 2 AND event_type IN ('view', 'error'))
SELECT event_type, slot, arg_max(event_id, (p, event_id)) AS event_id, arg_max(value, (p, event_id)) AS value, 3 AS version, true AS refused FROM u GROUP BY 1, 2"""
)
def concurrent_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-13, B-16, B-19, B-20, B-25: two writers begin at one version; the second to commit is refused where both touched a key, does its work anew, and nothing is lost."""
    e = tables.table(spark, sf_dir, "events").select("event_type", F.floor(F.col("event_id") / 8).alias("slot"), "event_id", "value")
    table = Table(spark, fresh(spark, "commits"), "event_type", "slot long, event_id long, value double, event_type string")
    best = F.row_number().over(Window.partitionBy("event_type", "slot").orderBy(F.desc("event_id")))
    table.append(e.where("event_id % 4 = 0").withColumn("_n", best).where("_n = 1").drop("_n"))
    one, two = table.begin(), table.begin()
    rows = e.where("event_id % 4 = 1 AND event_type IN ('click', 'view')")
    two.upsert(e.where("event_id % 4 = 2 AND event_type IN ('view', 'error')").withColumn("value", -F.col("value")), ["event_type", "slot"], "event_id")
    try:
        one.upsert(rows, ["event_type", "slot"], "event_id")
        refused = False
    except ConflictError:
        refused = True
        table.upsert(rows, ["event_type", "slot"], "event_id")
    return table.read().select("event_type", "slot", "event_id", "value", F.lit(table.refresh()).alias("version"), F.lit(refused).alias("refused"))


def _hourly(spark: SparkSession, sf_dir: str):
    hours = tables.table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("x"))
    return hours.orderBy("hour").toPandas()["x"].to_numpy()  # bounded by the calendar


@query()
def chunked_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-07: share of resamples whose t value passes 1.645, drawn in chunks of 500 as one generator gives them, each chunk a task."""
    t = draws.power(spark, _hourly(spark, sf_dir), 60, 3.0, 1_200, 10, 5, 500)
    return t.agg(F.count("*").alias("resamples"), F.avg((F.col("value") > 1.6448536269514722).cast("double")).alias("power"))


@query()
def chunked_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-08: quantiles of resampled means for several lengths of blocks, each with its own generator in chunks of 500."""
    x, out = _hourly(spark, sf_dir), None
    for block in (5, 10, 20):
        m = draws.means(spark, x, 1_000, block, 7).agg(F.count("*").alias("resamples"), *(F.percentile("value", q).alias(n) for n, q in (("one_sided", 0.05), ("low", 0.025), ("high", 0.975)))).withColumn("block", F.lit(block))
        out = m if out is None else out.unionByName(m)
    return out
