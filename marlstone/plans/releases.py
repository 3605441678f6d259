"""Queries on chains of releases: raw intervals, causal ones made from verified raw ones, wholes merged from these, features and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import releases, scans
from ..sources import sinks
from ..sources.scratch import fresh
from . import tables
from .registry import query
from .research import one_bars

H = clock.HOUR
_WEEK = 7 * clock.DAY
_PART = ["market", "week"]
_COLUMNS = ["market", "event_at_ns", "contract", "close_nano", "volume"]


def _stored(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Create-only files by market and interval, read again."""
    path = fresh(spark, name)
    sinks.parquet(rows.repartition(*_PART), path, tuple(_PART), ("event_at_ns",))
    return spark.read.schema(rows.schema).parquet(path)


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw bars by interval, as stored after their manifests were made: an early bar of some weeks has changed since, one market's second week is lost."""
    b = one_bars(spark, sf_dir).select(*_COLUMNS, clock.floor_div("event_at_ns", _WEEK).alias("week"))
    stated = releases.manifest(b, "raw", _PART, "event_at_ns", _COLUMNS)
    changed = (F.col("market") == "click") & (F.col("week") % 2 == 0) & (F.col("event_at_ns") % (11 * H) == 0)
    lost = (F.col("market") == "view") & (F.col("week") % 4 == 2)
    later = b.where(~lost).withColumn("close_nano", F.col("close_nano") + F.when(changed, 1).otherwise(0))
    return _stored(spark, later, "raw"), stated


_RAW = f"""{tables.bars_sql()}, one AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY market, event_at_ns ORDER BY contract DESC) = 1),
b AS (SELECT market, event_at_ns, contract, close_nano, volume, event_at_ns // {_WEEK} AS week FROM one),
s AS (SELECT market, week, count(*) AS rows, min(event_at_ns) AS first_ns, max(event_at_ns) AS last_ns, CASE WHEN market = 'view' AND week % 4 = 2 THEN 'MISSING' WHEN market = 'click' AND week % 2 = 0 AND count(*) FILTER (event_at_ns % {11 * H} = 0) > 0 THEN 'CHANGED' ELSE 'VERIFIED' END AS state FROM b GROUP BY 1, 2)"""


@query(f"WITH {_RAW} SELECT market, week, state FROM s")
def raw_interval_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-05, A-19: every interval of the stored raw bars against its manifest: what is as it was released, what has changed, what is gone."""
    stored, stated = _raw(spark, sf_dir)
    return releases.checked(stored, stated, "raw", _PART, "event_at_ns", _COLUMNS).select("market", "week", "state")


def _causal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Causal rows of verified raw intervals, dispositions added, and their manifests with the raw releases' ids."""
    stored, stated = _raw(spark, sf_dir)
    states = releases.checked(stored, stated, "raw", _PART, "event_at_ns", _COLUMNS)
    rows = releases.consumed(stored, states, _PART)
    kept = rows.withColumn("disposition", F.when(F.col("volume") >= 2, "ELIGIBLE").otherwise("THIN"))
    written = _stored(spark, kept.select(*_COLUMNS, "disposition", "source_id", "week"), "causal")
    sources = written.groupBy(*_PART).agg(F.min("source_id").alias("source_id"))
    return written, releases.manifest(written, "causal", _PART, "event_at_ns", [*_COLUMNS, "disposition"], sources)


@query(f"WITH {_RAW} SELECT market, week, rows, first_ns, last_ns, (SELECT count(*) FROM b WHERE b.market = s.market AND b.week = s.week AND volume >= 2) AS eligible, true AS sourced FROM s WHERE state = 'VERIFIED'")
def causal_interval_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-06: causal intervals, built from verified raw ones alone, each of which names the release that it came from."""
    rows, stated = _causal(spark, sf_dir)
    eligible = rows.groupBy(*_PART).agg(F.count_if(F.col("disposition") == "ELIGIBLE").alias("eligible"))
    return stated.join(eligible, _PART).select("market", "week", "rows", F.col("first").alias("first_ns"), F.col("last").alias("last_ns"), "eligible", F.col("source_id").isNotNull().alias("sourced"))


@query(
    f"""WITH {_RAW}, g AS (SELECT * FROM s WHERE state = 'VERIFIED'), e AS (SELECT market AS m, week // 4 AS t, count(*) AS n FROM s GROUP BY 1, 2)
SELECT market, week // 4 AS term, count(*) AS parts, sum(rows)::BIGINT AS rows, min(first_ns) AS first_ns, max(last_ns) AS last_ns, CASE WHEN count(*) < any_value(e.n) THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS state FROM g JOIN e ON e.m = g.market AND e.t = g.week // 4 GROUP BY market, week // 4"""
)
def merged_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-07, B-08: a market's intervals merged in their order after each was checked again; overlaps and missing intervals make the whole say so."""
    rows, stated = _causal(spark, sf_dir)
    states = releases.checked(rows, stated, "causal", _PART, "event_at_ns", [*_COLUMNS, "disposition"])
    term = clock.floor_div("week", 4)
    expected = one_bars(spark, sf_dir).select("market", clock.floor_div("event_at_ns", _WEEK).alias("week")).distinct().groupBy("market", term.alias("term")).agg(F.count("*").alias("parts"))
    out = releases.merged(stated.withColumn("term", term), states, _PART, ["market", "term"], expected)
    return out.select("market", "term", "parts", "rows", F.col("first").alias("first_ns"), F.col("last").alias("last_ns"), "state")


@query(
    f"""WITH {_RAW}, v AS (SELECT b.* FROM b JOIN s USING (market, week) WHERE s.state = 'VERIFIED'), f AS (SELECT market, week, event_at_ns, close_nano - lag(close_nano) OVER (PARTITION BY market ORDER BY event_at_ns) AS feature FROM v),
o AS (SELECT f.market, f.week, f.event_at_ns, n.close_nano - v.close_nano AS outcome FROM f JOIN v USING (market, event_at_ns) LEFT JOIN v n ON n.market = f.market AND n.event_at_ns = f.event_at_ns + {H})
SELECT market, week, count(*) AS features, count(feature) AS with_feature, count(outcome) AS matured, sum(feature)::BIGINT AS feature_sum, sum(outcome)::BIGINT AS outcome_sum, true AS paired FROM f JOIN o USING (market, week, event_at_ns) GROUP BY 1, 2"""
)
def feature_outcome_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-09, B-10: features and outcomes released apart, each naming the causal release; joined only where both were made from the same."""
    rows, stated = _causal(spark, sf_dir)
    ids = stated.select(*_PART, F.col("release_id").alias("source_id"))
    f = scans.previous(rows.select(*_COLUMNS, "week"), ["market"], ["event_at_ns"], {"close_nano": "was"}, 1_000 * H).select("market", "week", "event_at_ns", (F.col("close_nano") - F.col("was")).alias("feature"))
    later = rows.select("market", (F.col("event_at_ns") - H).alias("event_at_ns"), F.col("close_nano").alias("later"))
    o = rows.select("market", "week", "event_at_ns", "close_nano").join(later, ["market", "event_at_ns"], "left").select("market", "week", "event_at_ns", (F.col("later") - F.col("close_nano")).alias("outcome"))
    f, o = _stored(spark, f, "features"), _stored(spark, o, "outcomes")
    made = [releases.manifest(x, kind, _PART, "event_at_ns", ["market", "event_at_ns", value], ids).select(*_PART, F.col("source_id").alias(f"{kind}_source")) for x, kind, value in ((f, "features", "feature"), (o, "outcomes", "outcome"))]
    pairs = made[0].join(made[1], _PART).withColumn("paired", F.col("features_source") == F.col("outcomes_source"))
    both = f.join(o, [*_PART, "event_at_ns"]).join(pairs.where("paired"), _PART)
    return both.groupBy(*_PART, "paired").agg(F.count("*").alias("features"), F.count("feature").alias("with_feature"), F.count("outcome").alias("matured"), F.sum("feature").alias("feature_sum"), F.sum("outcome").alias("outcome_sum"))


@query(
    f"""WITH {tables.TRADES}, i AS (SELECT market AS family, instrument_id % 6 AS source, min(event_at_ns) // {clock.DAY} AS first_day, max(event_at_ns) // {clock.DAY} + 1 + any_value(instrument_id % 6) % 3 AS end_day, event_at_ns // {5 * clock.DAY} AS chunk, count(*) AS rows FROM trades WHERE (instrument_id % 6 + event_at_ns // {5 * clock.DAY}) % 4 <> 3 GROUP BY market, instrument_id % 6, event_at_ns // {5 * clock.DAY}),
l AS (SELECT *, max(end_day) OVER (PARTITION BY family, source ORDER BY first_day, end_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT family, source, first_day, end_day, rows, CASE WHEN reach IS NULL OR first_day >= reach THEN CASE WHEN reach < first_day THEN 'GAP' ELSE 'SELECTED' END WHEN end_day <= reach THEN 'REDUNDANT' ELSE 'OVERLAP' END AS state, coalesce(greatest(first_day - reach, 0), 0) AS missing_days FROM l"""
)
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21, A-23: half-open day intervals of each family and source in order: selected, after a gap, redundant, or an overlap that nobody has resolved."""
    t = tables.trades(spark, sf_dir)
    day = clock.floor_div("event_at_ns", clock.DAY)
    chunk = clock.floor_div("event_at_ns", 5 * clock.DAY)
    i = t.where((F.col("instrument_id") % 6 + chunk) % 4 != 3).groupBy(F.col("market").alias("family"), (F.col("instrument_id") % 6).alias("source"), chunk.alias("chunk")).agg(F.min(day).alias("first_day"), (F.max(day) + 1 + F.max(F.col("instrument_id") % 6) % 3).alias("end_day"), F.count("*").alias("rows"))
    reach = F.max("end_day").over(Window.partitionBy("family", "source").orderBy("first_day", "end_day").rowsBetween(Window.unboundedPreceding, -1))  # intervals, not rows
    n = i.withColumn("reach", reach)
    state = F.when(F.col("reach").isNull() | (F.col("first_day") == F.col("reach")), "SELECTED").when(F.col("first_day") > F.col("reach"), "GAP").when(F.col("end_day") <= F.col("reach"), "REDUNDANT").otherwise("OVERLAP")
    return n.select("family", "source", "first_day", "end_day", "rows", state.alias("state"), F.greatest(F.coalesce(F.col("first_day") - F.col("reach"), F.lit(0)), F.lit(0)).alias("missing_days"))
