"""Causal window features over bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from . import scans


def true_range(w: Window) -> Column:
    was = F.lag("close_nano").over(w)
    h, low = F.col("high_nano"), F.col("low_nano")
    return F.when(was.isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - was), F.abs(low - was)))


def mean_atr(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean true range of the last n bars, null before there are n."""
    w = Window.partitionBy(*keys).orderBy("event_at_ns")
    last = w.rowsBetween(1 - n, 0)
    with_tr = bars.withColumn("true_range", true_range(w))
    return with_tr.withColumn("atr", F.when(F.count("*").over(last) == n, F.avg("true_range").over(last)))


def wilder_series(bars: DataFrame, keys: list[str], n: int, step: int, span: int | None = None) -> DataFrame:
    """Each bar with ``run_start``, its run's first bar, ``bars``, its place in the run, and Wilder's ``atr``, null before the n-th.

    The recursion is seeded with the mean of the run's first n true ranges: these don't age, all later ones by one a
    bar. So it is a decayed sum, and a run may be cut into blocks of ``span``.
    """
    rate = 1 - 1 / n
    span = span or scans.decay_span(rate, step)
    b = scans.previous(bars, keys, ["event_at_ns"], {"event_at_ns": "_at_before", "close_nano": "_was"}, span)
    new = F.col("_at_before").isNull() | (F.col("event_at_ns") - F.col("_at_before") != step)
    h, low, was = F.col("high_nano"), F.col("low_nano"), F.col("_was")
    b = b.withColumn("true_range", F.when(new, h - low).otherwise(F.greatest(h - low, F.abs(h - was), F.abs(low - was))))
    b = scans.latest(b, keys, ["event_at_ns"], F.when(new, F.col("event_at_ns")), "run_start", span)
    b = b.withColumn("bars", clock.floor_div(F.col("event_at_ns") - F.col("run_start"), step) + 1).drop("_at_before", "_was")
    if n == 1:
        return b.withColumn("atr", F.col("true_range").cast("double"))
    out = scans.decayed(b, [*keys, "run_start"], ["event_at_ns"], F.col("true_range") / n, F.greatest(F.col("bars") - n, F.lit(0)), rate, "_sum", span)
    return out.withColumn("atr", F.when(F.col("bars") >= n, F.col("_sum"))).drop("_sum")


def wilder_atr(bars: DataFrame, keys: list[str], n: int, step: int, span: int | None = None) -> DataFrame:
    """Last value of Wilder's recursion in each run of contiguous bars: keys, run (from 0), run_start, event_at_ns, bars, atr."""
    last = wilder_series(bars, keys, n, step, span).groupBy(*keys, "run_start").agg(F.max(F.struct("event_at_ns", "bars", "atr")).alias("_last"))
    last = last.select(*keys, "run_start", "_last.*")
    return scans.numbered(last, keys, ["run_start"], "run", span or scans.decay_span(1 - 1 / n, step)).withColumn("run", F.col("run") - 1)


def wilder_windows(rows: DataFrame, keys: list[str], number: str, tr: str, n: int, steps: int, every: int) -> DataFrame:
    """Wilder's recursion over the last n + steps true ranges alone, at every ``every``-th row from the first that has them.

    ``number`` counts a key's rows from 1; the first has no true range. Each row goes to the few windows that hold it,
    with its weight there, and these are sums that tasks combine before they shuffle them.
    """
    rate, first = 1 - 1 / n, n + steps + 1
    i = F.col(number)
    reach = F.sequence(i + F.pmod(F.lit(first) - i, F.lit(every)), i + (n + steps - 1), F.lit(every).cast("long"))
    dealt = rows.where(F.col(tr).isNotNull()).select(*keys, i.alias("_i"), F.col(tr).alias("_tr"), F.explode(F.filter(reach, lambda x: x >= first)).alias("bar"))
    weight = F.pow(F.lit(rate), F.least(F.col("bar") - F.col("_i"), F.lit(steps))) / n
    return dealt.groupBy(*keys, "bar").agg(F.sum(F.col("_tr") * weight).alias("atr"), F.count("*").alias("_n"), F.min(F.col("bar") - F.col("_i")).alias("_youngest")).where(f"_n = {n + steps} and _youngest = 0").drop("_n", "_youngest")


def overlapping(bars: DataFrame, at: str, span: int, reach: int) -> DataFrame:
    """``bars`` dealt over buckets of ``span``, those that the next bucket looks back on, up to ``reach``, into that, too.

    ``_own`` says whether a row is in its own bucket: windows over a key and ``_bucket`` are whole for those rows.
    """
    bucket = clock.floor_div(at, span)
    both = F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))
    return bars.withColumn("_in", F.explode(both)).where(F.col("_in.own") | (F.col(at) >= F.col("_in.b") * span - reach)).withColumn("_bucket", F.col("_in.b")).withColumn("_own", F.col("_in.own")).drop("_in")


def features(bars: DataFrame, keys: list[str], step: int, n: int = 61, span: int = 1_000) -> DataFrame:
    """The causal feature vector of each bar that ends n contiguous bars of one key; the others aren't listed.

    Where n covers the longest of the windows, which is 21 bars, these reach back n steps at most, as the bars are
    contiguous; a key is then dealt over buckets of ``span`` steps.
    """
    bars = overlapping(bars, "event_at_ns", span * step, n * step) if n > 20 else bars.withColumns({"_bucket": F.lit(0), "_own": F.lit(True)})
    w = Window.partitionBy(*keys, "_bucket").orderBy("event_at_ns")
    c, o = F.col("close_nano"), F.col("open_nano")
    vol = F.log1p(F.col("volume").cast("double"))
    base = bars.withColumn("true_range", true_range(w)).withColumn("_log", F.log(c / F.lag(c).over(w))).withColumn("_vol", vol)
    last = lambda k: w.rowsBetween(1 - k, 0)
    atr = F.avg("true_range").over(last(20))
    sine, cosine = clock.cyclic(clock.minute_of_session(clock.ts("event_at_ns")))
    deviation = F.stddev_pop("_vol").over(last(n - 1))
    out = base.select(
        *keys, "event_at_ns",
        *((c / F.lag(c, k).over(w) - 1).alias(f"return_{k}") for k in (1, 5, 20)),
        ((F.col("high_nano") - F.col("low_nano")) / o).alias("range_fraction"),
        (atr / c).alias("atr_fraction"),
        F.when(atr > 0, (F.col("high_nano") - F.col("low_nano")) / F.nullif(atr, F.lit(0.0))).alias("range_over_atr"),
        F.stddev_pop("_log").over(last(20)).alias("realised_volatility"),
        F.col("_vol").alias("log_volume"),
        F.when(deviation > 0, (F.col("_vol") - F.avg("_vol").over(last(n - 1))) / F.nullif(deviation, F.lit(0.0))).otherwise(0.0).alias("volume_z"),
        sine.alias("sine"), cosine.alias("cosine"),
        (F.col("event_at_ns") - F.lag("event_at_ns", n - 1).over(w)).alias("_span"), "_own")
    return out.where((F.col("_span") == step * (n - 1)) & F.col("_own")).drop("_span", "_own")


def reported(bars: DataFrame, decisions: DataFrame, keys: list[str], at: str, n: int, span: int, stale: int) -> DataFrame:
    """For each decision: the last n reported bars by then, gaps allowed, and what is wrong with them.

    The window of n bars ends with each bar; an as-of pick takes the last one before the decision.
    """
    from .asof import as_of

    w = Window.partitionBy(*keys).orderBy("event_at_ns")
    ends = bars.withColumn("first_ns", F.lag("event_at_ns", n - 1).over(w)).withColumn("mean_close", F.when(F.col("first_ns").isNotNull(), F.avg("close_nano").over(w.rowsBetween(1 - n, 0))))
    found = as_of(decisions, ends.withColumn("last_ns", F.col("event_at_ns")), keys, at, "event_at_ns", ["first_ns", "last_ns", "mean_close"])
    state = F.when(F.col("first_ns").isNull(), "TOO_FEW_BARS").when(F.col("last_ns") - F.col("first_ns") > span, "SPAN_TOO_LONG").when(F.col(at) - F.col("last_ns") > stale, "STALE").otherwise("COMPLETE")
    return found.withColumn("state", state)


def drawdown(rows: DataFrame, keys: list[str], order: list[str], pnl: str, span: int = scans.SPAN) -> DataFrame:
    """Running equity, its peak (0 at least) and the distance to it; a key is cut into blocks of ``span`` of the first order column."""
    eq = scans.lifted(rows, keys, order, F.col(pnl), F.col(pnl), span)
    eq = eq.withColumn("equity", F.col("before") + F.col(pnl)).withColumn("peak", F.greatest(F.lit(0), "peak"))
    return eq.withColumn("drawdown", F.col("peak") - F.col("equity")).select(*rows.columns, "equity", "peak", "drawdown")


def prior_direction(sessions: DataFrame, keys: list[str], order: str, first: str, last: str) -> DataFrame:
    """Sign of the move of the last session before that had bars; sessions without any are skipped."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = F.signum(F.col(last) - F.col(first))
    return sessions.withColumn("_own", own).withColumn("prior_direction", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).cast("int")).drop("_own")


def metrics(trades: DataFrame, keys: list[str], order: list[str], pnl: str, per_year: float | None = None, capital: float | None = None) -> DataFrame:
    """Net, hit rate, Sharpe, Sortino and largest drawdown per key.

    Per period: population deviation, ratios are 0 where it is 0. With ``per_year`` and ``capital``: returns on the
    capital, sample deviation, times the root of the periods, null where it is 0.
    """
    dd = drawdown(trades, keys, order, pnl)
    x = F.col(pnl).cast("double")
    if per_year:
        r = x / capital
        sharpe = F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * math.sqrt(per_year)
        down = F.sqrt(F.avg(F.least(r, F.lit(0.0)) * F.least(r, F.lit(0.0))))
        sortino = F.avg(r) / F.nullif(down, F.lit(0.0)) * math.sqrt(per_year)
    else:
        sharpe = F.coalesce(F.avg(x) / F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(0.0))
        down = F.sqrt(F.avg(F.least(x, F.lit(0.0)) * F.least(x, F.lit(0.0))))
        sortino = F.coalesce(F.avg(x) / F.nullif(down, F.lit(0.0)), F.lit(0.0))
    return dd.groupBy(*keys).agg(F.count("*").alias("trades"), F.sum(pnl).alias("net"), F.avg((x > 0).cast("double")).alias("hit_rate"), sharpe.alias("sharpe"), sortino.alias("sortino"), F.max("drawdown").alias("max_drawdown"))
